"""Cases that the operators once left out."""

import random

import pytest
from test_brute_force import brute_ctw, distance, nearest

from quillgraph.llm.ctw import DEPTH, code_lengths
from quillgraph.llm.license_templates import TEMPLATES
from quillgraph.llm.licenses import MAX_ERROR, find_all, license_spans
from quillgraph.llm.linedup import duplicate_lines
from quillgraph.llm.textkit import word_hashes


@pytest.mark.parametrize("depth", [4, 5, 6])
def test_deep_contexts(spark, depth):
    rng = random.Random(depth)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_ctw([t.encode() for t in texts], depth)
    for limit in (1 << 20, 0):
        got = {r.doc_id: r.bits for r in code_lengths(docs, depth, limit).collect()}
        assert all(abs(got[i] - w) < 1e-6 * max(1, w) for i, w in enumerate(want))


def test_default_context_spans_five_bytes(spark):
    """Each byte repeats the one five before it; four bytes of context say nothing about it."""
    rng = random.Random(3)
    text = [rng.choice("ab") for _ in range(5)]
    for i in range(4000):
        text.append(text[i] if i % 5 else rng.choice("ab"))
    text = "".join(c.upper() if i % 2 else c for i, c in enumerate(text))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert DEPTH >= 5
    assert code_lengths(docs).first().bits < 0.8 * code_lengths(docs, 3).first().bits


def test_licences_with_all_allowed_errors(spark):
    """Every template with as many wrong, missing and additional words as are allowed, also evenly spread and in one run."""
    rng = random.Random(12)
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        words = text.lower().replace("-", " ").split()
        n = len(word_hashes(text))
        for trial in range(24):
            own, most = list(words), int(MAX_ERROR * n)
            for e in range(most):
                p = (e * len(own) // most + 2) % len(own) if trial % 3 == 0 else min(5 + e, len(own) - 1) if trial % 3 == 1 else rng.randrange(len(own))
                kind = trial // 3 % 3 if trial < 18 else rng.randrange(3)
                own[p : p + (kind != 1)] = ["zz"] if kind != 2 else []
            rows.append((len(rows), f"some words before it {' '.join(own)} and some more after"))
    want = set()
    for i, text in rows:
        own = word_hashes(text).tolist()
        for name, template in TEMPLATES.items():
            item = word_hashes(template).tolist()
            errors, end = nearest(item, own)
            if errors <= int(MAX_ERROR * len(item)):
                want.add((i, name, errors, end))
    got = {(r.doc_id, r.template, r.errors, r.end) for r in license_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(want) > 200 and {name for _, name, _, _ in want} == set(TEMPLATES) and want <= got


def test_licences_close_together(spark):
    notice, mit = "All rights reserved.", "Released under the MIT License."
    rows = [(1, " ".join([notice] * 5)), (2, f"{notice} x {notice}"), (3, f"{mit} Released under MIT License. {mit}")]
    got = sorted((r.doc_id, r.start, r.end, r.errors) for r in license_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 3 * i, 3 * i + 3, 0) for i in range(5)] + [(2, 0, 3, 0), (2, 4, 7, 0), (3, 0, 5, 0), (3, 4, 9, 1), (3, 9, 14, 0)]


def test_find_all():
    """What is found lies as near as said, in parts that share nothing, and nothing within the errors is left between."""
    rng = random.Random(13)
    for _ in range(400):
        item, most = tuple(rng.choice("abc") for _ in range(rng.randint(3, 9))), rng.randint(0, 2)
        text = [c for _ in range(rng.randint(0, 5)) for c in [*rng.choices("abcd", k=rng.randint(0, 4)), *(x for x in item if rng.random() < 0.9)]]
        found, past = find_all(item, text, most), 0
        for d, end in found:
            begin = max(b for b in range(past, end + 1) if distance(item, text[b:end]) == d)
            assert d <= most and nearest(item, text[past:begin])[0] > most
            past = end
        assert nearest(item, text[past:])[0] > most


def test_lines_with_a_replaced_word(spark):
    """Pairs with one stretch replaced, removed or put in, up to a sixteenth of the line, and pairs with one character more than that."""
    rng = random.Random(14)
    lines, want = [], set()
    for n in (200, 255, 256, 391, 488, 611, 764, 1200, 2384, 24000):
        for place in (0, 0.3, 0.5, 0.7, 1):
            for left, put in ((1, 1), (0.5, 1), (1, 0), (1, 17 / 16)):
                base = "".join(rng.choice("abcde ") for _ in range(n // 4))
                most = len(base) // 16
                gone, new = int(left * most), int(put * most) + (put > 1)
                at = int(place * (len(base) - gone))
                other = base[:at] + "z" * new + base[at + gone :]
                if max(gone, new) <= min(len(base), len(other)) // 16:
                    want.add((len(lines) + 1, len(lines)))
                lines += [base, other]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {(r.doc_id, r.kept_doc_id) for r in duplicate_lines(docs).collect()}
    assert len(want) > 100 and got == want
