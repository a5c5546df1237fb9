"""Where intermediate results live: the folder that all executors share.

Lineage is cut by a reliable checkpoint or by a written table, both in the folder named by
``spark.checkpoint.dir``. Executor-local copies are never relied on, so any executor may be lost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


#: Bytes up to which a table is sent to every executor.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and checkpointed in the shared folder. For small and middling results."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: compressed, splittable, with statistics."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files that df reads, a table from stored whose readers are done."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _row_bytes(name: str, kind: T.DataType) -> Column:
    """About the bytes of a value in memory; arrays of numbers count by their length, others by their text."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.size(c) * 8
    return F.lit(8) if isinstance(kind, T.AtomicType) else F.octet_length(F.to_json(F.array(c)))


def table_bytes(df: DataFrame) -> int:
    """About the bytes that df takes in memory. For tables that are computed already: it is an aggregate over all of it."""
    each = sum((F.coalesce(_row_bytes(f.name, f.dataType), F.lit(0)) for f in df.schema), F.lit(16))
    return df.agg(F.sum(each.cast("bigint"))).first()[0] or 0


def hinted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint where it was measured and is small; beyond limit bytes Spark chooses, by a shuffle if need be."""
    return F.broadcast(df) if table_bytes(df) <= limit else df
