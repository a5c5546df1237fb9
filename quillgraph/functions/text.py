"""Scalar text functions as Column expressions, without UDFs.

Nulls stay null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NO_PATHS, NO_ENTITIES, NO_DESCRIPTIONS = "No paths found.", "No entities found.", "No descriptions available."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """One space for every run of white space, Unicode's included, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalize_name(c: Column | str) -> Column:
    return collapse(F.lower(col(c)))


def normalize_type(c: Column | str) -> Column:
    return F.upper(strip(c))


def normalize_relation(c: Column | str) -> Column:
    return F.lower(strip(c))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def title_case(c: Column | str) -> Column:
    """The first letter of every run of letters in upper case, the others in lower case: o'neil 2nd -> O'Neil 2Nd."""
    cased = lambda chars: F.transform(chars, lambda x, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(x)).otherwise(F.upper(x)))
    return F.array_join(bound(F.split(col(c), "", -1), cased), "")


def sha256(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def joined(*parts: Column | str) -> Column:
    """Parts on lines of their own; null where any is null."""
    return reduce(lambda a, b: F.concat(a, F.lit("\n"), b), map(col, parts))


def paragraph_id(title: Column | str, text: Column | str) -> Column:
    return F.concat(col(title), F.lit("__"), F.substring(sha256(joined(title, text)), 1, 10))


def is_hash(c: Column | str) -> Column:
    return col(c).rlike("^[0-9a-f]{64}$")


def canonical_description(c: Column | str) -> Column:
    """The distinct parts between bars, sorted."""
    parts = F.filter(F.transform(F.split(col(c), r" \| ", -1), strip), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), " | ")


def canonical_paragraph(title: Column | str, text: Column | str) -> Column:
    return F.when(F.coalesce(col(title), F.lit("")) == "", strip(text)).otherwise(F.concat(F.lit("**"), col(title), F.lit("**: "), strip(text)))


def embedding_text(name: Column | str, description: Column | str) -> Column:
    return F.concat(F.lit("**"), title_case(name), F.lit("**: "), canonical_description(description))


def mentions(text: Column | str, name: Column | str) -> Column:
    """Whether text holds name as a substring, letter case aside; an empty name is in every text."""
    return F.lower(col(text)).contains(F.lower(col(name)))


def append_distinct(old: Column, new: Column) -> Column:
    """One step of a description's growth: new is appended after a bar unless old contains it; nulls never change old."""
    return F.when(old.isNull(), new).when(new.isNull() | old.contains(new), old).otherwise(F.concat(old, F.lit(" | "), new))


def fold_descriptions(ordered: Column) -> Column:
    """append_distinct over an array of strings; null where it has none."""
    return F.aggregate(ordered, F.lit(None).cast("string"), append_distinct)


def normalize_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; null counts as empty."""
    plain = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), PUNCTUATION, "")
    return collapse(F.regexp_replace(plain, r"(?U)\b(?:the|an?)\b", " "))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), " ", -1), lambda x: x != "")


def exact_match(prediction: Column | str, truth: Column | str) -> Column:
    return (normalize_answer(prediction) == normalize_answer(truth)).cast("double")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often then uses it; also inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _numbered(words: Column) -> Column:
    """Every word with the number of its occurrence, so that sets of them are multisets of words."""
    return bound(F.array_sort(words), lambda ws: F.transform(ws, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(ws, w)).cast("string"))))


def token_f1(prediction: Column | str, truth: Column | str) -> Column:
    """F1 of the multisets of tokens; 1 where both are empty, 0 where one is or nothing is shared."""

    def score(z: Column) -> Column:
        shared, p, t = F.size(F.array_intersect(z["p"], z["t"])), F.size(z["p"]), F.size(z["t"])
        precision, recall = shared / p, shared / t
        return F.when((p == 0) | (t == 0), (p == t).cast("double")).when(shared == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))

    words = lambda c: _numbered(tokens(normalize_answer(c)))
    return bound(F.struct(words(prediction).alias("p"), words(truth).alias("t")), score)


def verdict(prediction: Column | str, answer: Column | str) -> Column:
    """A judge's text as 1 or 0; a blank prediction is wrong without asking."""
    yes = F.upper(strip(F.coalesce(col(answer), F.lit("")))).startswith("YES")
    return F.when(strip(F.coalesce(col(prediction), F.lit(""))) == "", 0.0).otherwise(yes.cast("double"))


def path_text(names: Column | str, edges: Column | str, quote: str = "'") -> Column:
    """A path as a chain of arrows; later names between quotes."""
    names, edges = col(names), col(edges)
    step = lambda e, i: F.concat(
        F.when(e["forward"], F.concat(F.lit(" --["), e["relation"], F.lit("]--> "))).otherwise(F.concat(F.lit(" <--["), e["relation"], F.lit("]-- "))),
        F.lit(quote), F.get(names, i + 1), F.lit(quote),
    )
    return F.concat(F.get(names, F.lit(0)), F.array_join(F.transform(edges, step), ""))


def weighted_path_text(names: Column | str, edges: Column | str, weight: Column | str) -> Column:
    return F.format_string("[%.4f] %s", col(weight), path_text(names, edges, ""))


def prompt(template: str, **values: Column) -> Column:
    """A template with {name} places, filled by columns."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), values[name]]
    return F.concat(*out, F.lit(rest))
