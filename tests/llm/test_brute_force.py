"""Each operator against a plain version that looks at everything."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm.cdx import CDX_SQL, LoserTree, capture_index
from quillgraph.llm.ctw import code_lengths
from quillgraph.llm.decontam import Pieces, contaminated, errors, myers_find, normal
from quillgraph.llm.license_templates import TEMPLATES
from quillgraph.llm.licenses import license_spans
from quillgraph.llm.linedup import banded_distance, similar_lines, within
from quillgraph.llm.packing import best_fit_packing, pack
from quillgraph.llm.quality import QUALITY_SQL, quality_lines
from quillgraph.llm.simhash import RADIUS, TOTAL, fingerprints, near_duplicates
from quillgraph.llm.textkit import Lines, Prefix, Words, slices
from quillgraph.llm.toxicity import DRIFT, segments, toxic_documents
from quillgraph.llm.urllm import accepted_urls, url_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def noisy(rng, x, n, alphabet="abc"):
    y = list(x)
    for _ in range(n):
        p, kind = rng.randint(0, len(y)), rng.random()
        if kind < 0.34:
            y.insert(p, rng.choice(alphabet))
        elif p < len(y):
            y[p : p + 1] = [] if kind < 0.67 else [rng.choice(alphabet)]
    return "".join(y)


@pytest.mark.parametrize("name, run, sql", [("documents", quality_lines, QUALITY_SQL), ("pages", capture_index, CDX_SQL)])
def test_sql(spark, name, run, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.sql(sql).df()
    got = run(spark.read.parquet(f"{SF}/{name}.parquet")).toPandas()[list(want.columns)]
    key = list(want.columns[:3])
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_words_and_lines():
    texts = ["Hello, WÖRLD x1", "", "a\n\nb c", "…", "é"]
    w = Words(pa.array(texts))
    assert [w.text(i) for i in range(len(w.hash))] == ["hello", "wörld", "x1", "a", "b", "c", "…", "é"]
    assert w.row.tolist() == [0, 0, 0, 2, 2, 2, 3, 4] and w.counts.tolist() == [3, 0, 3, 1, 1]
    assert len(w.grams(2)[0]) == 4
    lines = Lines(pa.array(texts))
    assert [lines.text(i) for i in range(len(lines.start))] == ["Hello, WÖRLD x1", "", "a", "", "b c", "…", "é"]
    assert lines.number.tolist() == [0, 0, 0, 1, 2, 0, 0]
    p = Prefix(lines.coded())
    assert p.of(np.array([0]), np.array([5]))[0] != p.of(np.array([1]), np.array([6]))[0]
    assert [b - a for a, b in slices(pa.array(["x" * 10] * 7 + ["y" * 50]), 25)] == [2, 2, 2, 1, 1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(tau):
    rng = random.Random(tau)
    left = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    right = [noisy(rng, x, rng.randint(0, tau + 2)) for x in left]
    assert within(left, right, tau).tolist() == [distance(x, y) <= tau for x, y in zip(left, right)]
    assert banded_distance(np.array([[1, 2, 3]]), np.array([[1, 3, -1]]), np.array([3]), np.array([2]), 2).tolist() == [1]


def test_similar_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 40))) for _ in range(60)]
    lines = sorted({y for x in base for y in [x, *(noisy(rng, x, rng.randint(1, 4), "abcdé") for _ in range(4))] if len(y) >= 20})
    docs = spark.createDataFrame([(i, "\n".join(lines[i::7])) for i in range(7)], "doc_id bigint, text string")
    parsed = Lines(pa.array(["\n".join(lines)]))
    name = dict(zip(lines, (Prefix(parsed.coded()).of(parsed.start, parsed.end) & ~np.uint64(1)).view(np.int64).tolist()))
    want = {tuple(sorted((name[x], name[y]))) for i, x in enumerate(lines) for y in lines[i + 1 :] if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2}
    got = [tuple(r) for r in similar_lines(docs).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_near_duplicates(spark, docs):
    """One row per document: its number of links and its class, of copies, near copies and texts of few words alike."""
    rng = random.Random(8)
    texts = [r.text for r in docs.collect()]
    few = ["one two three", "one two three four", "one, two, three", "red green blue five six seven", "red green blue five six seven eight"]
    rows = list(enumerate(texts)) + [(1000 + i, noisy(rng, t, len(t) // 200)) for i, t in enumerate(texts) if len(t) > 200] + [(5000 + i, t) for i, t in enumerate(few)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = fingerprints(made).toPandas()
    f1, f2, ids = prints.f1.to_numpy().view(np.uint64), prints.f2.to_numpy().view(np.uint64), prints.doc_id.to_numpy()
    links, group, short = dict.fromkeys(ids.tolist(), 0), {}, 0
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    for i in range(len(ids)):
        d = np.bitwise_count(f1[i] ^ f1).astype(int)
        e = d + np.bitwise_count(f2[i] ^ f2)
        for j in np.flatnonzero((d <= RADIUS) & (e <= TOTAL)):
            if i != j:
                links[int(ids[i])] += 1
                short += e[j] > 0 and min(prints.n_words[i], prints.n_words[j]) < 8
                a, b = sorted((find(int(ids[i])), find(int(ids[j]))))
                group[b] = a
    want = sorted((i, find(i), n) for i, n in links.items())
    got = sorted(tuple(r) for r in near_duplicates(made).collect())
    assert sum(links.values()) > 100 and short > 0 and got == want
    planted = [(i - 1000, i) for i, _ in rows if 1000 <= i < 5000]
    found = {i: c for i, c, _ in got}
    assert sum(found[a] == found[b] for a, b in planted) >= 0.9 * len(planted)


def test_fingerprint_is_the_majority(spark):
    text = " ".join(f"w{i}" for i in range(700))
    got = fingerprints(spark.createDataFrame([(1, text), (2, text + " " + text)], "doc_id bigint, text string")).collect()
    assert got[0][1:] == got[1][1:] and got[0].n_words == 700


def test_myers():
    rng = random.Random(5)
    for _ in range(500):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode()
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25))).encode()
        assert myers_find(item, text, 99)[0] == min(nearest(item, text)[0], len(item))


@pytest.mark.parametrize("group_bytes", [1 << 20, 200])
def test_contaminated(spark, docs, group_bytes):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(8).collect()]
    texts = [r.text[:400] for r in docs.limit(30).collect()]
    texts += [texts[i][:100] + noisy(rng, t, n, "xyz ") + texts[i][100:300] for i, (_, t) in enumerate(items) for n in (0, 4, len(t) // 14, len(t) // 8)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, x in items:
            n, end = nearest(normal(x), normal(t))
            if n <= errors(len(normal(x))):
                want.add((d, i, n, max(0, end - len(normal(x))), end))
    got = {tuple(r) for r in contaminated(made, spark.createDataFrame(items, "item_id bigint, text string"), group_bytes=group_bytes).collect()}
    assert len(want) >= 16 and got == want


def test_license_spans(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "license", "under"]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        rows.append((i, f"{fill(20)}\n{text}\n{fill(15)}"))
        want.add((i, name))
        mangled = text.split()
        for at in range(8, len(mangled), 25):
            mangled[at] = "changed"
        rows.append((100 + i, f"{fill(5)} {' '.join(mangled)} {fill(5)}"))
        want.add((100 + i, name))
    rows.append((500, fill(500)))
    got = license_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {(r.doc_id, r.template) for r in got}
    assert want <= found and not any(r.doc_id == 500 for r in got)
    assert {r.start for r in got if r.doc_id < 100 and (r.doc_id, r.template) in want} == {20}
    twice = license_spans(spark.createDataFrame([(1, TEMPLATES["mit-notice"] + " " + fill(50) + " " + TEMPLATES["mit-notice"])], "doc_id bigint, text string")).collect()
    assert sorted((r.start, r.end) for r in twice) == [(0, 5), (55, 60)]


def test_maximal_segments():
    """Ruzzo and Tompa's definition: repeatedly the best remaining segment, the shortest first, of what lies outside those taken."""

    def brute(x, at=0):
        best = max(((sum(x[i:j]), i - j, -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        s, _, _, i, j = best
        return brute(x[:i], at) + [(at + i, at + j, s)] + brute(x[j:], at + j)

    rng = random.Random(9)
    for _ in range(300):
        x = [rng.choice([-0.25, -0.25, -0.25, 0.7, 1.3, 2.1]) for _ in range(rng.randint(0, 14))]
        hits = [i for i, v in enumerate(x) if v > 0]
        got = segments(hits, [x[i] for i in hits], DRIFT)
        assert [g[:2] for g in got] == [b[:2] for b in brute(x)] and all(abs(g[2] - b[2]) < 1e-9 for g, b in zip(got, brute(x)))


def test_toxic_held_out(spark):
    rng = random.Random(10)
    words = [f"word{i}" for i in range(3000)]
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(3, 6) if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        if i < 600:
            labels.append((i, 1, int(toxic)))
    found = {r.doc_id for r in toxic_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    held = range(600, 1200)
    assert sum(i in found for i in held if i % 6 == 0) >= 95 and sum(i in found for i in held if i % 6) <= 5


def brute_ctw(texts, depth):
    """Code lengths with trees of dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    spots = []
    for t in texts:
        own = []
        padded = bytes(depth) + t
        for i in range(depth, len(padded)):
            for k in range(8):
                node, bit = (1 << k) | (padded[i] >> (8 - k)), (padded[i] >> (7 - k)) & 1
                own.append((node, bit, padded[i - depth : i]))
                for d in range(depth + 1):
                    counts[padded[i - d : i], node][bit] += 1
        spots.append(own)
    children = defaultdict(set)
    for c, node in counts:
        if c:
            children[c[1:], node].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}

    def weigh(c, node):
        if (c, node) not in weighted:
            own = kt(*counts[c, node])
            if len(c) == depth:
                weighted[c, node] = own
            else:
                weighted[c, node] = np.logaddexp(own, sum(weigh(x, node) for x in children[c, node])) - math.log(2)
        return weighted[c, node]

    def chance(c, node, bit, full):
        own = (counts[c, node][bit] + 0.5) / (sum(counts[c, node]) + 1)
        if len(c) == depth:
            return own
        stop = math.exp(kt(*counts[c, node]) - math.log(2) - weigh(c, node))
        return stop * own + (1 - stop) * chance(full[depth - len(c) - 1 :], node, bit, full)

    return [-sum(math.log2(chance(b"", node, bit, full)) for node, bit, full in own) for own in spots]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_code_lengths(spark, depth):
    rng = random.Random(depth)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_ctw([t.encode() for t in texts], depth)
    for limit in (1 << 20, 0):
        got = {r.doc_id: r.bits for r in code_lengths(docs, depth, limit).collect()}
        assert all(abs(got[i] - w) < 1e-6 * max(1, w) for i, w in enumerate(want))


def test_loser_tree():
    rng = random.Random(11)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert [x for (x,) in LoserTree([iter([(v,) for v in r]) for r in runs])] == sorted(sum(runs, []))


def test_capture_histories(spark):
    rng = random.Random(12)
    rows = [(rng.randint(0, 400), f"http://{rng.choice(['a.com', 'www.a.com:80', 'b.a.com'])}/p{rng.randint(0, 3)}#x", rng.choice(["one", "two", None])) for _ in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    want = con.sql(CDX_SQL).df().sort_values("position")
    got = capture_index(pages, run_rows=37, part_rows=50).toPandas().sort_values("position")
    got, want = got.astype({"length": "Int64"}), want.astype({"length": "Int64"})
    for c in want.columns:
        assert [str(x) for x in got[c].astype(object).where(got[c].notna(), None)] == [str(x) for x in want[c].astype(object).where(want[c].notna(), None)], c
    assert got.revisit.sum() > 10 and got.capture_no.max() > 30


def test_url_models(spark):
    rng = random.Random(13)
    good, bad = ["news", "blog", "garden", "river"], ["cheap-pills", "casino-win", "spam-farm"]
    rows = [(i, f"https://{rng.choice(good if i % 5 else bad)}{rng.randint(0, 99)}.example.com/{rng.randint(0, 999)}") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    a, b = (url_scores(pages, broadcast_grams=n).toPandas().sort_values("page_id") for n in (1 << 20, 0))
    assert np.allclose(a.score, b.score)
    kept = {r.page_id for r in accepted_urls(pages).collect()}
    assert all((i in kept) == bool(i % 5) for i, _ in rows)
    # The threshold by trying all places between scores, on the held-out examples.
    held = a[a.held]
    steps = sorted({round(x / 0.005) for x in held.score})
    cost = lambda t: sum(held.bad & (held.score >= t)) / sum(held.bad) + 10 * sum(~held.bad & (held.score < t)) / sum(~held.bad)
    edges = [(x - 0.5) * 0.005 for x in [*steps, steps[-1] + 2]]
    least = min(map(cost, edges))
    rest = [x for x in a.score if x not in set(held.score)]
    sure = [t for t in edges if cost(t) == least]
    assert {r.page_id for r in accepted_urls(pages).collect()} == set(a.page_id[a.score >= (min(sure) + max(sure)) / 2]) and rest

    def plain(urls, n=4):
        """Witten-Bell by dictionaries, per class."""
        out = []
        for cls in (False, True):
            count = Counter()
            for u, is_bad in urls:
                x = bytes(n) + u.encode()
                for i in range(n, len(x)):
                    for d in range(n + 1):
                        count[x[i - d : i], x[i]] += is_bad == cls
            total, kinds = Counter(), Counter()
            for (c, y), v in count.items():
                total[c] += v
                kinds[c] += v > 0

            def p(c, y):
                if not c:
                    return (count[b"", y] + 1) / (total[b""] + 256)
                low = p(c[1:], y)
                return (count[c, y] + kinds[c] * low) / (total[c] + kinds[c]) if total[c] else low

            out.append([sum(math.log(p(x[i - n : i], x[i])) for i in range(n, len(x))) / max(1, len(x) - n) for x in (bytes(n) + u.encode() for u, _ in urls)])
        return np.array(out[0]) - np.array(out[1])

    urls = [(u, i % 5 == 0) for i, u in rows[:60]]
    few = url_scores(pages.where("page_id < 60"), held_out=0).toPandas().sort_values("page_id")
    assert np.allclose(few.score, plain(urls))


def test_packing(spark, docs):
    rng = random.Random(14)
    for capacity in (1, 3, 10, 100, 2048):
        sizes = sorted((min(capacity, max(1, int(rng.lognormvariate(0, 1.2) * capacity / 6))) for _ in range(2000)), reverse=True)
        bins = pack(sizes, capacity)
        used, large = Counter(), Counter()
        for s, b in zip(sizes, bins):
            used[b] += s
            large[b] += 3 * s > capacity
        assert max(used.values()) <= capacity and max(large.values()) <= (2 if capacity > 1 else 1)
        assert len(used) <= 1.05 * sum(sizes) / capacity + 2
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    covered = defaultdict(list)
    for r in best_fit_packing(docs, 256).collect():
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            covered[d] += range(s, s + n)
    assert {d: sorted(c) for d, c in covered.items()} == {d: list(range(n)) for d, n in words.items() if n}
