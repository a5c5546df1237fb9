"""Both ways of every choice by size, the methods inside, and what stays small when the input grows."""

import math
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_brute_force import distance

from quillgraph.llm.ctw import CostTable, code_lengths
from quillgraph.llm.decontam import Pieces, drop_contaminated
from quillgraph.llm.licenses import license_spans
from quillgraph.llm.license_templates import TEMPLATES
from quillgraph.llm.linedup import STRETCH_CHARS, TAU, _keys, _met, drop_duplicate_lines, duplicate_lines, one_stretch, within
from quillgraph.llm.packing import pack
from quillgraph.llm.simhash import BLOCKS, RADIUS, VantageTree, drop_near_duplicates, fingerprints, near_duplicates, near_links, near_pairs
from quillgraph.llm.textkit import word_hashes
from quillgraph.llm.toxicity import DRIFT, HELD_OUT, PRIOR_CORPUS, PRIOR_EACH, expected_together, extreme_value_scale, segments, toxic_documents
from quillgraph.llm.urllm import SEEDS, accepted_urls, threshold
from quillgraph.operators.components import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


def rows(df):
    return sorted(map(str, df.collect()))


# --- lines


@pytest.fixture(scope="module")
def lined(spark):
    """Documents that all hold one line, with repeats, lines within two edits, and lines with a word replaced."""
    rng = random.Random(30)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    base = [" ".join(word() for _ in range(rng.choice((5, 8, 60)))) for _ in range(25)]
    out = []
    for d in range(60):
        own = ["one line that stands in every document"]
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            if rng.random() < 0.3 and len(line) > 100:
                at = rng.randrange(len(line) - 20)
                line[at : at + 6] = "QQQQQQ"
            own.append("".join(line))
        out.append((d % 57, "\n".join(own + ["short"])))
    return out


@pytest.fixture(scope="module")
def repeats(lined):
    """Every occurrence that is not the first of its group, with the first, by comparing all lines with all."""
    rows = lined
    places = sorted({(d, n, x) for d, t in rows for n, x in enumerate(t.split("\n")) if len(x) >= 20})
    lines = sorted({x for _, _, x in places})
    parent = {x: x for x in lines}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, x in enumerate(lines):
        for y in lines[i + 1 :]:
            if abs(len(x) - len(y)) <= max(TAU, min(len(x), len(y)) // STRETCH_CHARS) and (one_stretch([x], [y])[0] or within([x], [y], TAU)[0]):
                parent[find(x)] = find(y)
    first = {}
    for d, n, x in places:
        first[find(x)] = min(first.get(find(x), (d, n)), (d, n))
    return sorted({(d, n, *first[find(x)]) for d, n, x in places if first[find(x)] != (d, n)})


def test_one_stretch():
    rng = random.Random(31)
    for _ in range(300):
        x = "".join(rng.choice("ab") for _ in range(rng.randint(32, 80)))
        a, n = rng.randrange(len(x)), rng.randint(0, 6)
        y = x[:a] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) + x[a + n :]
        most = min(len(x), len(y)) // STRETCH_CHARS
        want = any(x[:p] == y[:p] and x[len(x) - q :] == y[len(y) - q :] and max(len(x), len(y)) - p - q <= most for p in range(min(len(x), len(y)) + 1) for q in [next(q for q in range(min(len(x), len(y)) - p, -1, -1) if x[len(x) - q :] == y[len(y) - q :])])
        assert one_stretch([x], [y])[0] == want


def test_duplicate_lines_against_all(spark, lined, repeats):
    want = repeats
    docs = spark.createDataFrame(lined, DOC)
    hot = [w for w in want if w[1] == 0]
    assert len(hot) == 56 and len(want) > 150
    for keys, limit in ((1 << 20, 1 << 20), (-1, -1)):
        assert sorted(tuple(r) for r in duplicate_lines(docs, broadcast_keys=keys, broadcast_bytes=limit).collect()) == want


def test_drop_duplicate_lines_against_all(spark, lined, repeats):
    gone = {(d, n) for d, n, _, _ in repeats}
    want = []
    for d, t in lined:
        kept = [x for n, x in enumerate(t.split("\n")) if (d, n) not in gone]
        if any(x.strip() for x in kept):
            want.append((d, "\n".join(kept)))
    docs = spark.createDataFrame(lined, DOC)
    for limit in (1 << 20, -1):
        assert sorted(tuple(r) for r in drop_duplicate_lines(docs, broadcast_bytes=limit).collect()) == sorted(want)


def test_changes_apart_end_in_the_merge():
    """Lines that share a half but differ in changes apart from each other are no candidates; all that differ in one stretch are, at any place and length."""
    rng = random.Random(37)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [text(rng.randint(50, 700)) for _ in range(400)]
    one, two = [], []
    for x in base:
        most = len(x) // 17
        at, size = rng.randint(0, len(x) - most), rng.randint(0, most)
        one.append(x[:at] + text(rng.randint(0, most)) + x[at + size :])
        at = len(x) // 2 + 2
        two.append(x[:at] + "QRSTUV" + x[at + 6 : at + len(x) // 3] + "ZYXWJK" + x[at + len(x) // 3 + 6 :])

    def candidates(other):
        batches = [pa.RecordBatch.from_pydict({"text": [line]}) for line in base + other]
        key, line, sketch = (np.concatenate(x) for x in zip(*([b.column(c).to_numpy().view(np.uint64) for c in ("key", "line", "sketch")] for b in _keys(iter(batches), TAU, 20))))
        order = np.argsort(key, kind="stable")
        names = [int(next(_keys(iter([b]), TAU, 20)).column("line")[0].as_py()) & ~1 for b in batches]
        met = _met(key[order], line[order], sketch[order], 4 * TAU)
        pairs = {p for b in met for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
        return sum(tuple(sorted((x, y))) in pairs for x, y in zip(names, names[len(base) :])), len(pairs)

    different = [i for i, (x, y) in enumerate(zip(base, one)) if x != y]
    assert all(one_stretch(base, one)[i] for i in different) and candidates(one)[0] == len(different)
    assert candidates(two)[1] < 100


# --- licences


def test_license_spans_are_what_they_say(spark):
    """Both ways of the joins give the same, and every span lies as near as it says."""
    rng = random.Random(32)
    made = []
    for i, (_, text) in enumerate(sorted(TEMPLATES.items())):
        words = text.split()
        for at in range(rng.randint(0, 9), len(words), 12):
            words[at] = "other"
        made.append((i, f"some words {text} and {' '.join(words)} end"))
    docs = spark.createDataFrame(made, DOC)
    found = license_spans(docs).collect()
    assert rows(license_spans(docs, broadcast_rows=-1, broadcast_spans=-1)) == sorted(map(str, found))
    for r in found:
        own, item = word_hashes(made[r.doc_id][1]).tolist(), word_hashes(TEMPLATES[r.template]).tolist()
        assert r.errors == min(distance(item, own[b : r.end]) for b in range(max(0, r.end - len(item) - r.errors), r.end)) <= 0.2 * len(item)


# --- toxicity


def test_chance_of_many_segments(spark):
    df = spark.createDataFrame([(float(t), r) for t in (0.5, 30, 200, 700) for r in (1, 2, 10, 11, 40, 150)], "t double, r int")
    for x in df.withColumn("p", expected_together(F.col("t"), F.col("r"))).collect():
        want = math.exp(-x.t + (x.r - 1) * math.log(max(x.t, 1)) - math.lgamma(x.r + 1) - math.lgamma(x.r))
        assert x.p == pytest.approx(want, rel=1e-9, abs=1e-300)


def plain_toxicity(docs, labels, held):
    """(expected, score) by document; held tells which labels calibrate."""
    texts = {d: t.split() for d, t in docs}
    n, toxic, clean = Counter(), Counter(), Counter()
    for d, words in texts.items():
        for w in set(words):
            n[w] += 1
            if d in labels and d not in held:
                (toxic if labels[d] else clean)[w] += 1
    total, t_all, c_all = sum(n.values()), sum(toxic.values()), sum(clean.values())
    weight = PRIOR_EACH * len(n) + PRIOR_CORPUS
    score, p = {}, {}
    for w in n:
        prior = PRIOR_EACH + PRIOR_CORPUS * n[w] / total
        t, c = toxic[w] + prior, clean[w] + prior
        odds = math.log(t / (t_all + weight - t)) - math.log(c / (c_all + weight - c))
        if odds / math.sqrt(1 / t + 1 / c) >= 2 and odds > 0:
            score[w], p[w] = min(odds, 6.0), c / (c_all + weight)
    rounded = defaultdict(float)
    for w in score:
        rounded[math.floor(score[w] * 100 + 0.5) / 100] += p[w]
    scale = extreme_value_scale(np.array(list(rounded.values())), np.array(list(rounded)), DRIFT)
    found = {}
    for d, words in texts.items():
        at = [i for i, w in enumerate(words) if w in score]
        found[d] = segments(at, [score[words[i]] for i in at])
    calm = [d for d in held if not labels[d]]
    log_k = math.log((sum(s >= 3 for d in calm for _, _, s in found[d]) + 0.5) / sum(len(texts[d]) for d in calm)) + 3 * scale
    out = {}
    for d, own in found.items():
        size = math.log(len(texts[d])) if texts[d] else 0
        good = [s for _, _, s in own if s >= 3 and math.exp(log_k + size - scale * s) <= 1]
        if good:
            r, t = len(good), scale * sum(good) - len(good) * (log_k + size)
            together = math.exp(-t + (r - 1) * math.log(max(t, 1)) - math.lgamma(r + 1) - math.lgamma(r))
            out[d] = min(math.exp(log_k + size - scale * max(s for _, _, s in own)), together), sum(good)
    return out


def test_toxic_documents_against_plain_statistics(spark):
    rng = random.Random(33)
    words = [f"word{i}" for i in range(400)]
    bad = ["idiot", "moron", "scum", "trash"]
    made, labels = [], {}
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.choice((30, 90, 900)))]
        for _ in range(rng.randint(2, 5) if i % 5 == 0 else rng.random() < 0.1):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        if i % 50 == 0:  # passages all over the text, many more than ten
            for at in range(0, len(text), 40):
                text[at : at + 2] = ["idiot", "scum"]
        made.append((i, " ".join(text)))
        if i % 3:
            labels[i] = int(i % 5 == 0)
    ids = spark.createDataFrame([(i,) for i in labels], "doc_id bigint")
    held = {r.doc_id for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).collect()}
    want = plain_toxicity(made, labels, held)
    docs, table = spark.createDataFrame(made, DOC), spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxic_documents(docs, table, max_expected=1e9).collect()}
    assert set(got) == set(want) and max(len(r.starts) for r in got.values()) > 10
    for d, (expected, score) in want.items():
        assert got[d].score == pytest.approx(score) and got[d].expected == pytest.approx(expected, rel=1e-6)
    other = toxic_documents(docs.union(docs.where("doc_id < 3")), table, max_expected=1e9)
    joined = toxic_documents(docs.union(docs.where("doc_id < 3")), table, max_expected=1e9, broadcast_tokens=-1, broadcast_labels=-1)
    plain = lambda df: sorted((r.doc_id, r.n_tokens, round(r.score, 6), tuple(r.starts)) for r in df.collect())
    assert plain(other) == plain(joined)


# --- decontamination


def test_many_items_take_little_memory():
    rng = np.random.default_rng(34)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = pa.array([" ".join(words[rng.integers(0, 5000, 20)]) for _ in range(40_000)] + ["the same item in several rows of the benchmark"] * 3)
    pieces = Pieces(np.arange(len(texts)), texts, 16, 32)
    size = sum(len(t) for t in pieces.texts)
    assert len(pickle.dumps(pieces)) < 3.1 * size and len(pieces.texts) == 40_001 and len(pieces.ids) == 40_003
    data = np.frombuffer(b"before " + pieces.texts[77] + b" after", np.uint8)
    assert {i for _, i, _, _ in pieces.candidates(data, np.array([0, len(data)]))} >= {77}


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_dropping_by_broadcast_and_join(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__gone", F.lit("mine"))
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept, unique = drop_contaminated(docs, benchmark, broadcast_bytes=limit), drop_near_duplicates(docs, broadcast_bytes=limit)
    assert kept.columns == unique.columns == docs.columns
    assert 0 < kept.count() < docs.count() and 0 < unique.count() < docs.count() and kept.where("__gone <> 'mine'").isEmpty()


# --- near copies


def test_chunks_and_links(spark):
    """Shards cut into many chunks give the same pairs, and links join the same documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    edited = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), F.regexp_replace("text", "(?i)e", "E").alias("text"))
    cut = docs.where("length(text) > 300").select((F.col("doc_id") + 20_000).alias("doc_id"), F.expr("substring(text, 30)").alias("text"))
    prints = fingerprints(docs.union(edited).union(cut)).dropDuplicates(["f1", "f2"]).select("doc_id", "f1", "f2").cache()
    want = rows(near_pairs(prints))
    assert len(want) > 100 and rows(near_pairs(prints, shard_rows=20)) == want
    links = near_links(prints, shard_rows=30)
    assert rows(connected_components(links, "doc_id_a", "doc_id_b")) == rows(connected_components(near_pairs(prints), "doc_id_a", "doc_id_b"))


def test_rows_follow_the_documents(spark):
    """A cluster of near copies takes a row for each document, not for each pair, in one tile or in many, and with few links held at a time."""
    words = [f"word{i}" for i in range(400)]
    docs = spark.createDataFrame([(d, " ".join(words[:d] + words[d + 1 :])) for d in range(120)] + [(d + 1000, " ".join(words)) for d in range(3)], DOC)
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(found) == 123 and {r.class_id for r in found.values()} == {0} and sum(r.n_links for r in found.values()) > 2000
    assert rows(near_duplicates(docs, shard_rows=15)) == rows(near_duplicates(docs))


def test_few_comparisons():
    """The share of pairs compared falls as trees grow, and leaves reach every value within the radius."""
    rng = np.random.default_rng(36)
    share = []
    for bits in (7, 10):
        trees = [VantageTree(bits, np.full(1 << bits, 32), RADIUS // BLOCKS, 32, k) for k in range(BLOCKS)]
        share.append(sum(len(r) for t in trees for r in t.reach) / 4**bits)
        v = rng.integers(0, 1 << bits, 50)
        for tree in trees:
            leaf = np.searchsorted(tree.first, tree.rank[v], "right") - 1
            near = np.bitwise_count(v[:, None] ^ v) <= RADIUS // BLOCKS
            assert all(tree.rank[w] in tree.reach[leaf[i]] for i in range(50) for w in v[near[i]])
    assert share[1] < share[0] < 1 and share[1] < 0.25


# --- language model, URLs, packing


def test_cost_table():
    rng = np.random.default_rng(35)
    gram = np.unique(rng.integers(0, 1 << 48, 3_000_000, dtype=np.uint64))
    gram[0] = 0
    bits = rng.random(len(gram)).astype(np.float32)
    table = CostTable(gram, bits)
    assert table.keys.nbytes + table.bits.nbytes <= 32 * len(gram)
    at = rng.integers(0, len(gram), 100_000)
    assert (table.of(gram[at]) == bits[at]).all() and table.of(gram[:1])[0] == bits[0]


def test_large_model_in_passes(spark):
    """A table beyond the bound is sent in parts, with the same bits as in one, without a shuffle of the documents' grams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "a"), (-1, ""), (-2, None)], DOC))
    plain = lambda df: sorted((str(r.doc_id), r.n_bytes, round(r.bits, 4)) for r in df.collect())
    passes = code_lengths(docs, broadcast_grams=1 << 16)
    assert plain(passes) == plain(code_lengths(docs)) and "MapInArrow" not in passes._jdf.queryExecution().toString()
    table = CostTable(np.arange(0, 1000, 2, dtype=np.uint64), np.ones(500, np.float32))
    assert table.of(np.arange(1000, dtype=np.uint64)).tolist() == [1.0, 0.0] * 500


def test_threshold():
    count = lambda *x: np.array(x)
    assert threshold(count(-2.0, 1.0), count(0, 9), count(5, 0)) == -0.5
    assert threshold(count(1.0, -2.0), count(9, 0), count(0, 5)) == -0.5
    assert threshold(count(0.4, 1.0), count(1, 9), count(0, 0)) == 0.0 and threshold(count(-0.4, 1.0), count(1, 9), count(0, 0)) == -0.4
    assert threshold(count(0.4), count(0), count(5)) == 0.0 and threshold(np.zeros(0), np.zeros(0), np.zeros(0)) == 0.0


def test_sites_that_no_seed_names(spark):
    """One word after another is no seed: URLs of its sites train neither model, and the rest still tells them apart."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").cache()
    seeded = F.col("url").rlike(SEEDS)
    caught = n = 0
    for word in ("casino", "spam", "adult", "free-bets", "pills", "ads-track"):
        kept = accepted_urls(pages, bad=F.when(F.col("url").contains(word), None).otherwise(seeded))
        mine = pages.where(F.col("url").contains(word)).count()
        n, caught = n + mine, caught + mine - kept.where(F.col("url").contains(word)).count()
        assert kept.where(~seeded).count() >= 0.999 * pages.where(~seeded).count()
    assert caught >= 0.8 * n


def plain_packing(sizes, capacity):
    """Contents of the bins by looking at all partners and all gaps."""
    large, bins = [s for s in sizes if 3 * s > capacity], []
    while large:
        own = [large.pop(0)]
        fits = [x for x in large if x <= capacity - own[0]]
        if fits:
            large.remove(max(fits))
            own.append(max(fits))
        bins.append(own)
    for s in (s for s in sizes if 3 * s <= capacity):
        fits = [b for b in bins if capacity - sum(b) >= s]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(s)
        else:
            bins.append([s])
    return sorted(map(sum, bins))


@pytest.mark.parametrize("capacity", [5, 30, 200])
def test_packing_takes_the_largest_partner_and_the_smallest_gap(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        sizes = sorted((rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 4)) for _ in range(120)), reverse=True)
        used = Counter()
        for s, b in zip(sizes, pack(sizes, capacity)):
            used[b] += s
        assert sorted(used.values()) == plain_packing(sizes, capacity)
