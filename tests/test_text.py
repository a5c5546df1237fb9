import string
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions import vectors as V


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first().x


def plain_normal(s):
    kept = s.lower().translate(dict.fromkeys(map(ord, string.punctuation)))
    return " ".join(w for w in kept.split() if w not in {"the", "an", "a"})


def plain_f1(p, t):
    p, t = plain_normal(p).split(), plain_normal(t).split()
    if not p or not t:
        return float(p == t)
    n = sum((Counter(p) & Counter(t)).values())
    return 2 * (n / len(p)) * (n / len(t)) / (n / len(p) + n / len(t)) if n else 0.0


NAMES = ["  Two  Words\t", "o'neil", "mcdonald-smith", "2nd of 3rd", "", "É a"]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = df.select(T.normalize_name("n").alias("a"), T.title_case("n").alias("b")).collect()
    assert [r.a for r in got] == [" ".join(n.lower().split()) for n in NAMES]
    assert [r.b for r in got] == [n.title() for n in NAMES]


def test_hashes(spark):
    import hashlib

    h = hashlib.sha256("Title\ntext é".encode()).hexdigest()
    assert one(spark, T.paragraph_id("t", "x"), t="Title", x="text é") == f"Title__{h[:10]}"
    assert one(spark, T.is_hash("t"), t=h) and not one(spark, T.is_hash("t"), t=h[:-1])


def test_descriptions(spark):
    assert one(spark, T.canonical_description("d"), d="b | a |  | b") == "a | b"
    assert one(spark, T.canonical_paragraph("t", "d"), t="T", d=" x ") == "**T**: x" and one(spark, T.canonical_paragraph("t", "d"), t=None, d=" x ") == "x"
    assert one(spark, T.embedding_text("t", "d"), t="ann lee", d="z | y") == "**Ann Lee**: y | z"
    fold = T.fold_descriptions(F.array(*map(F.lit, ["born in", "in", None, "lives"])))
    assert one(spark, fold, t="") == "born in | lives"
    assert one(spark, T.fold_descriptions(F.array(F.lit("in"), F.lit("born in"))), t="") == "in | born in"


ANSWERS = ["", "the", "A.", "The Cat, the dog", "cat dog cat", "café an été", "!!!", "theatre a-the", "Éa the", "x" * 50]


def test_scores(spark):
    pairs = [(p, t) for p in ANSWERS for t in ANSWERS]
    df = spark.createDataFrame(pairs, "p string, t string").select("p", "t", T.normalize_answer("p").alias("n"), T.exact_match("p", "t").alias("em"), T.token_f1("p", "t").alias("f1"))
    for r in df.collect():
        assert r.n == plain_normal(r.p) and r.em == float(plain_normal(r.p) == plain_normal(r.t)) and r.f1 == pytest.approx(plain_f1(r.p, r.t))
    assert one(spark, T.token_f1("p", "t"), p=None, t=None) == 1.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ab the,.", max_size=20), st.text("ab the,.", max_size=20)), min_size=20, max_size=20))
def test_f1_property(spark, pairs):
    for r in spark.createDataFrame(pairs, "p string, t string").select("p", "t", T.token_f1("p", "t").alias("f1")).collect():
        assert r.f1 == pytest.approx(plain_f1(r.p, r.t))


def test_verdict_and_texts(spark):
    assert [one(spark, T.verdict("p", "a"), p=p, a=a) for p, a in (("x", " yes."), ("x", "no"), (" ", "yes"), ("x", None))] == [1.0, 0.0, 0.0, 0.0]
    names = F.array(*map(F.lit, ["a", "b", "c"]))
    edges = F.array(F.struct(F.lit("r").alias("relation"), F.lit(True).alias("forward")), F.struct(F.lit("s").alias("relation"), F.lit(False).alias("forward")))
    assert one(spark, T.path_text(names, edges), t="") == "a --[r]--> 'b' <--[s]-- 'c'"
    assert one(spark, T.weighted_path_text(names, edges, F.lit(0.5)), t="") == "[0.5000] a --[r]--> b <--[s]-- c"
    assert one(spark, T.prompt("Q: {q}? {r}", q=F.col("t"), r=F.lit("!")), t="why") == "Q: why? !"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine("a", "b").alias("c"), V.relu(V.cosine("a", "b")).alias("r")).collect()
    assert got[0].c == pytest.approx(0.5**0.5) and got[1].c is None and got[2].c is None and got[3].c == -1
    assert [r.r for r in got[1:]] == [0.0, 0.0, 0.0]
    assert df.select(V.relu(F.lit(float("nan"))).alias("r")).first().r == 0.0
