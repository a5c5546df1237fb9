"""Operator 7, external merge of a web archive's capture index.

Captures are index lines, ordered by (URL key, capture time, page). Every task sorts what it reads into runs of bounded size, which are
stored: page bodies are read once, and reduced to digest and length before anything moves. The stored runs are range-partitioned by the
order, into as many partitions as their number of lines needs, so that a partition's lines fit in memory however large the index is; each
partition merges the pieces of all runs with a loser tree, which costs one comparison per level for each line. The merge also numbers the
captures of a URL and compares digests. Range boundaries may fall inside the history of one URL, so a hot URL spreads over partitions;
what a history needs from the partition before (captures so far, last digest) is one row a partition, carried over on the driver.

The merge is sequential by nature and runs in Python, line by line over the index, not over the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.storage import cut, remove, stored

#: Captures in a sorted run.
RUN_ROWS = 1 << 20
#: Captures that a partition merges, about: the bounds of the partitions are sampled.
PART_ROWS = 1 << 18
#: Pages have no capture time; the synthetic one walks through a year in steps of this many seconds.
YEAR_SECONDS, STEP_SECONDS = 31_536_000, 7919

URL_PARTS = r"^[a-z][a-z0-9+.\-]*://([^/?#]*)([^#]*)"


def url_key(url: Column) -> Column:
    """Sortable key of a URL: host labels reversed, then path and query, in lower case, without scheme, user, port, www and fragment.

    A URL without scheme and host is its own key, in lower case.
    """
    low = F.lower(url)
    host = F.regexp_replace(F.regexp_extract(low, URL_PARTS, 1), r"^.*@|:[0-9]*$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    rest = F.regexp_extract(low, URL_PARTS, 2)
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(low.rlike(URL_PARTS), surt).otherwise(low)


def captures(pages: DataFrame) -> DataFrame:
    """(urlkey, ts, page_id, digest, length) of pages with a URL and a page_id; digest and length are null without a body."""
    seconds = F.pmod(F.col("page_id").cast("bigint") * STEP_SECONDS, F.lit(YEAR_SECONDS))
    ts = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + seconds), "yyyyMMddHHmmss")
    return pages.where("url IS NOT NULL AND page_id IS NOT NULL").select(
        url_key(F.col("url")).alias("urlkey"), ts.alias("ts"), F.col("page_id").cast("bigint").alias("page_id"), F.md5("html").alias("digest"), F.octet_length("html").cast("bigint").alias("length")
    )


ORDER = ("urlkey", "ts", "page_id")
COLUMNS = (*ORDER, "digest", "length")
_SORT = [(c, "ascending") for c in (*ORDER, "digest", "length")]


def _runs(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs, each with a number of its own."""
    number = TaskContext.get().partitionId() << 20
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= run_rows:
            yield from _run(held, number)
            held, number = [], number + 1
    if held:
        yield from _run(held, number)


def _run(batches: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    table = table.take(pc.sort_indices(table, sort_keys=_SORT, null_placement="at_start"))
    yield from table.append_column("run", pa.array([number] * len(table), pa.int64())).to_batches(1 << 14)


class LoserTree:
    """K-way merge of sorted iterators: an inner node keeps the loser of its match, so a new head plays only its path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._enter(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _enter(self, i: int) -> None:
        """Builds the tree: i climbs until it meets a free node."""
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while (head := self.heads[self.winner]) is not None:
            yield head
            i = self.winner
            self.heads[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node:
                other = self.losers[node]
                if self._before(other, i):
                    self.losers[node], i = i, other
                node //= 2
            self.winner = i


MERGED_SCHEMA = "urlkey string, ts string, page_id bigint, digest string, length bigint, part int, line bigint, nth bigint, revisit boolean"


def _sort_key(row: tuple) -> tuple:
    """A total order, nulls of digest and length first."""
    key, ts, page, digest, length = row
    return key, ts, page, digest is not None, digest or "", length is not None, length or 0


def _falls(batch: pa.RecordBatch) -> list[int]:
    """Where a line is before the one above it: there, pieces of a run from different fetches adjoin."""
    if batch.num_rows < 2:
        return []
    falls, equal = pa.scalar(False), pa.scalar(True)
    for name in ORDER:
        upper, lower = batch.column(name).slice(0, batch.num_rows - 1), batch.column(name).slice(1)
        falls = pc.or_(falls, pc.and_(equal, pc.less(lower, upper)))
        equal = pc.and_(equal, pc.equal(lower, upper))
    return (falls.to_numpy(zero_copy_only=False).nonzero()[0] + 1).tolist()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    tables: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        numbers = batch.column("run").to_numpy()
        cuts = sorted({0, batch.num_rows, *((numbers[1:] != numbers[:-1]).nonzero()[0] + 1).tolist(), *_falls(batch)})
        for a, b in zip(cuts, cuts[1:]):
            tables.setdefault(int(numbers[a]), []).append(batch.slice(a, b - a).select(list(COLUMNS)))

    def rows(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
        for piece in pieces:
            for row in zip(*(c.to_pylist() for c in piece.columns)):
                yield _sort_key(row), row

    def ordered(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
        """A run's pieces in order of their first lines, which is the order they had in the run."""
        firsts = [_sort_key(tuple(c[0].as_py() for c in p.columns)) for p in pieces]
        return rows([p for _, p in sorted(zip(firsts, pieces), key=lambda x: x[0])])

    out: list[tuple] = []
    before, digest, nth = None, None, 0
    for line, (_, row) in enumerate(LoserTree([ordered(p) for _, p in sorted(tables.items())])):
        same = row[0] == before
        nth = nth + 1 if same else 1
        out.append((*row, part, line, nth, same and digest is not None and row[3] == digest))
        before, digest = row[0], row[3]
        if len(out) == 1 << 14:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    names = [*COLUMNS, "part", "line", "nth", "revisit"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def capture_index(pages: DataFrame, run_rows: int = RUN_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(urlkey, ts, page_id, digest, length, capture_no, revisit, position): all captures in global order.

    capture_no counts the captures of one urlkey from 1; revisit tells that the capture before has the same digest; position is the
    place in the whole index, from 1. Order is by urlkey, ts, page_id, digest and length, nulls first, so ties are of equal rows only.

    Rows without url or page_id are left out; a null body has a null digest, which is never a revisit; an empty one has the digest of nothing and length 0,
    and a very long one is digested whole. Repeated rows are captures of their own. An empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    runs = stored(captures(pages).mapInArrow(lambda it: _runs(it, run_rows), "urlkey string, ts string, page_id bigint, digest string, length bigint, run bigint"), "runs")
    parts = max(1, -(-runs.count() // part_rows))
    merged = cut(runs.repartitionByRange(parts, *ORDER).mapInArrow(_merge, MERGED_SCHEMA))
    remove(runs)
    ends = merged.groupBy("part").agg(F.count("*").alias("n"), F.min_by("urlkey", "line").alias("first"), F.max_by(F.struct("urlkey", "nth", "digest"), "line").alias("last")).orderBy("part").collect()
    carried, total, key, nth, digest = [], 0, None, 0, None
    for e in ends:  # one row a partition
        same = e["first"] == key
        carried.append((e["part"], total, key, nth if same else 0, digest))
        total += e["n"]
        # A partition of one key only adds to what it was given.
        nth = e["last"]["nth"] + (nth if same and e["last"]["urlkey"] == e["first"] else 0)
        key, digest = e["last"]["urlkey"], e["last"]["digest"]
    offsets = spark.createDataFrame(carried, "part int, before bigint, carried_key string, carried bigint, carried_digest string")
    continued = F.col("urlkey") == F.col("carried_key")
    # The line before is in the same partition, or, for its first line, the one that was carried.
    again = F.when(F.col("line") == 0, F.coalesce(continued & (F.col("digest") == F.col("carried_digest")), F.lit(False))).otherwise(F.col("revisit"))
    return merged.join(F.broadcast(offsets), "part").select(
        *COLUMNS,
        (F.col("nth") + F.when(continued, F.col("carried")).otherwise(0)).alias("capture_no"),
        again.alias("revisit"),
        (F.col("before") + F.col("line") + 1).alias("position"),
    )


CDX_SQL = f"""
WITH parts AS (
  SELECT page_id, html, lower(url) AS low, regexp_extract(lower(url), '{URL_PARTS}', 1) AS host, regexp_extract(lower(url), '{URL_PARTS}', 2) AS rest
  FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL
), keyed AS (
  SELECT page_id, html, CASE WHEN regexp_matches(low, '{URL_PARTS}')
      THEN array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '^www[0-9]*\\.', ''), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END
      ELSE low END AS urlkey
  FROM parts
), lines AS (
  SELECT urlkey, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((page_id * {STEP_SECONDS}) % {YEAR_SECONDS} AS BIGINT)), '%Y%m%d%H%M%S') AS ts,
         page_id, md5(html) AS digest, CAST(strlen(html) AS BIGINT) AS length FROM keyed
)
SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY ts, page_id, digest NULLS FIRST, length NULLS FIRST) AS capture_no,
       coalesce(lag(digest) OVER (PARTITION BY urlkey ORDER BY ts, page_id, digest NULLS FIRST, length NULLS FIRST) = digest, false) AS revisit,
       row_number() OVER (ORDER BY urlkey, ts, page_id, digest NULLS FIRST, length NULLS FIRST) AS position
FROM lines
"""
