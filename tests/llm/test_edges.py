"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm.cdx import capture_index
from quillgraph.llm.ctw import code_lengths
from quillgraph.llm.decontam import contaminated, drop_contaminated
from quillgraph.llm.licenses import license_spans
from quillgraph.llm.linedup import drop_duplicate_lines, duplicate_lines
from quillgraph.llm.packing import best_fit_packing
from quillgraph.llm.quality import quality_lines
from quillgraph.llm.simhash import drop_near_duplicates, near_duplicates
from quillgraph.llm.toxicity import toxic_documents
from quillgraph.llm.urllm import accepted_urls

PROSE = "The quick brown fox jumps over the lazy dog near the quiet river bank today."
LONG = " ".join(f"word{i % 5000}x{i % 7}" for i in range(60_000)) + "."
CLASHES = ("judged", "gone", "__gone", "group", "n_lines", "n_removed", "key", "line", "toxic", "row", "gram", "bin", "item_id", "score", "component", "n_words", "lost")
ITEM = "benchmark question about seven purple elephants crossing the frozen northern lake"

ROWS = [
    (1, PROSE, "en", "a", 10),
    (1, PROSE, "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t\n ", "en", "a", 5),
    (5, LONG, "en", "a", len(LONG)),
    (None, PROSE, "en", None, 3),
    (6, PROSE, None, "b", None),
    (7, "é", "fr", "b", 1),
    (8, "\x00퟿ 😀   word", "xx", "b", 3),
    (9, "Released under the MIT License.\nYou stupid idiot. " + ITEM + ".", "en", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(None).cast("string") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 0, 1), (5, 1, 0), (None, 1, 1), (6, 1, None), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, ""), (4, "the")], "item_id bigint, text string")


def pages(spark, docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") != 7, F.concat(F.lit("https://www.a"), "doc_id", F.lit(".example.com/x"))).alias("url"), F.col("text").alias("html"), *CLASHES)


def test_quality(docs):
    out = {r.doc_id: r for r in quality_lines(docs).collect()}
    assert {1, 5, 6, 9} <= set(out) and not {2, 3, 4} & set(out)
    assert out[5].text == LONG and out[5].n_chars == len(LONG) and out[1].lost == 0
    assert quality_lines(docs).where("doc_id = 1").count() == 2 and quality_lines(docs).where("doc_id IS NULL").count() == 1
    assert quality_lines(docs.limit(0)).count() == 0


def test_licenses(docs):
    out = license_spans(docs)
    assert [tuple(r) for r in out.collect()] == [(9, "mit-notice", 0, 5, 0)]
    assert license_spans(docs.union(docs)).count() == 1 and license_spans(docs.limit(0)).count() == 0


def test_line_dedup(docs):
    assert [tuple(r) for r in duplicate_lines(docs).collect()] == [(6, 0, 1, 0)]
    assert duplicate_lines(docs.limit(0)).count() == 0
    kept = drop_duplicate_lines(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in left if x is not None) == [1, 1, 2, 3, 4, 5, 7, 8, 9] and None in left
    assert kept.where("doc_id = 5").first().text == LONG
    assert drop_duplicate_lines(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    assert toxic_documents(docs, labels).columns == ["doc_id", "n_tokens", "expected", "score", "starts", "ends", "scores"]
    for d, l in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.where("toxic = 0")), (docs, labels.where("toxic = 1"))):
        assert not {2, 3, 4} & {r.doc_id for r in toxic_documents(d, l).collect()}
    # Repeated rows, ties and a long text, with words that enough labelled documents hold.
    spark = docs.sparkSession
    made = [(i, PROSE + (" stupid idiot stupid idiot" if i % 2 else "")) for i in range(60)]
    made += [(1, made[1][1]), (100, LONG + " stupid idiot stupid idiot stupid idiot " + LONG), (101, LONG), (None, made[1][1])]
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    out = toxic_documents(spark.createDataFrame(made, "doc_id bigint, text string"), known, max_expected=1.0)
    found = sorted(r.doc_id for r in out.collect())
    assert found == sorted([*range(1, 60, 2), 1, 100])
    assert out.where("doc_id = 100").first().starts == [60_000] and out.where("doc_id = 1").distinct().count() == 1


def test_decontamination(docs, benchmark):
    assert [tuple(r)[:3] for r in contaminated(docs, benchmark).distinct().collect()] == [(9, 1, 0)]
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1 and kept.where("doc_id IS NULL").count() == 1
    assert contaminated(docs.limit(0), benchmark).count() == contaminated(docs, benchmark.limit(0)).count() == 0


def test_code_lengths(docs):
    for limit in (1 << 20, 0):
        out = code_lengths(docs, broadcast_grams=limit)
        rows = {r.doc_id: r for r in out.collect()}
        assert out.count() == docs.count()
        assert rows[2].n_bytes == rows[3].n_bytes == 0 and rows[2].bits == 0 and rows[2].bits_per_byte is None
        assert rows[5].n_bytes == len(LONG) and rows[7].n_bytes == 2 and rows[7].bits > 0
        assert code_lengths(docs.limit(0), broadcast_grams=limit).count() == 0


def test_capture_index(spark, docs):
    p = pages(spark, docs)
    out = capture_index(p).orderBy("position").collect()
    assert [r.position for r in out] == list(range(1, 10))
    assert [(r.capture_no, r.revisit) for r in out if r.page_id == 1] == [(1, False), (2, True)]
    assert [(r.digest, r.length) for r in out if r.page_id == 2] == [(None, None)] and [r.length for r in out if r.page_id == 3] == [0]
    assert [(r.digest, r.length) for r in out if r.page_id == 5] == [(hashlib.md5(LONG.encode()).hexdigest(), len(LONG))]
    assert capture_index(p.limit(0)).count() == 0


def test_simhash(docs):
    found = near_duplicates(docs)
    assert sorted(tuple(r) for r in found.where("n_links > 0").collect()) == [(1, 1, 1), (6, 1, 1)]
    assert found.where("n_links = 0 AND class_id <> doc_id").isEmpty() and found.count() == found.select("doc_id").distinct().count()
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1 and kept.where("doc_id = 6").count() == 0
    assert near_duplicates(docs.limit(0)).count() == drop_near_duplicates(docs.limit(0)).count() == 0


def test_url_filter(spark, docs):
    p = pages(spark, docs)
    out = accepted_urls(p)
    assert out.where("url IS NULL").count() == 0 and out.where("page_id = 1").count() == 2
    assert accepted_urls(p.limit(0)).count() == 0 and accepted_urls(p.withColumn("url", F.lit("http://spam.example/"))).count() == 0
    assert accepted_urls(p.withColumn("url", F.lit(""))).count() == p.count()
    rows = [(i, f"https://news{i % 20}.example.org/{i}") for i in range(100)] + [(i, f"https://spam{i % 20}.example.org/{i}") for i in range(100, 200)]
    rows += [(200, "https://news3.example.org/" + "12345" * 20_000), (201, "https://spam3.example.org/9"), (202, "https://spam3.example.org/9"), (None, "https://news1.example.org/1")]
    kept = accepted_urls(spark.createDataFrame(rows, "page_id bigint, url string"))
    assert sorted(r.page_id for r in kept.where("page_id IS NOT NULL").collect()) == [*range(100), 200] and kept.where("page_id IS NULL").count() == 1


def test_packing(docs):
    out = best_fit_packing(docs, capacity=1000).collect()
    pieces = [(d, s, n) for r in out for d, s, n in zip(r.doc_ids, r.starts, r.lengths)]
    assert sum(n for d, _, n in pieces if d == 5) == 60_000 and sum(d == 1 for d, _, _ in pieces) == 2
    assert {d for d, _, _ in pieces} == {1, 5, 6, 7, 8, 9} and all(r.used == sum(r.lengths) <= 1000 for r in out)
    assert best_fit_packing(docs.limit(0)).count() == 0 and best_fit_packing(docs.where("text = ''")).count() == 0


def test_stages_keep_what_clashes(spark, docs, benchmark, tmp_path):
    """Columns that are named like what the operators add come back with their values and types."""
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    mine = docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mine, str(tmp_path))
        assert out.schema.simpleString() == mine.schema.simpleString(), name
        assert [tuple(r) for r in out.select(*CLASHES).distinct().collect()] == [tuple(f"mine {c}" for c in CLASHES)], name


def test_stages(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (docs, docs.limit(0)):
        at = d
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            folder = str(tmp_path / f"{k}-{d is docs}")
            out.write.parquet(folder)
            at = spark.read.parquet(folder)
        ids = {i for r in at.collect() for i in r.doc_ids}
        assert ids == ({1, 5} | ({7, 8} & ids) if d is docs else set())
