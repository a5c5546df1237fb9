"""Operator 1, line-first quality rules.

Every line is judged on its own; failing lines are removed; a document that loses too much text is rejected.
All rules are built-in SQL expressions, so a pass is one scan with neither a shuffle nor Python. Cheap
literal searches stand before patterns, and the lines of a document are split and judged once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import unused

#: Share of a document's characters (blank lines aside) that failing lines may hold.
MAX_LOST = 0.5
MIN_BARS = 3
MAX_SYMBOLS = 0.1
MIN_SHOUT = 3
MAX_ECHO = 0.3
ECHO_WORDS = 8
SHORT_WORDS = 3
#: Longest line that a stock phrase makes boilerplate; in a longer one it is part of the prose.
BOILERPLATE_CHARS = 200

BARS = (" | ", " » ", " › ", " • ", " · ")
SYMBOLS = r"[#$%&*^~=+<>{}\[\]\\|@_`]"
ENDING = r"[.!?…。！？:;,\"'”’»)\]0-9]$"
#: Notices of a licence are not boilerplate here: they are evidence, which the licence scan reads.
BOILERPLATE = (
    "(?i)(lorem ipsum|privacy policy|cookie policy|uses cookies|accept cookies|terms of (use|service)|enable javascript|click here"
    "|sign up for|subscribe to our|log in to|skip to (main )?content|share on (facebook|twitter)|read more$)"
)


def line_fails(line: Column, words: Column) -> Column:
    """True where a trimmed, non-empty line, given with its words, breaks a rule.

    Navigation: several bars between items. Punctuation: many symbol characters, or very few words
    without an ending. Shouting: capitals and no small letter. Echo: the same word again and again.
    Boilerplate: a stock phrase in a line of at most BOILERPLATE_CHARS characters.
    """
    size = F.length(line)
    bars = reduce(lambda a, b: a + b, [(size - F.length(F.replace(line, F.lit(b), F.lit("")))) / 3 for b in BARS])
    symbols = size - F.length(F.regexp_replace(line, SYMBOLS, ""))
    echoes = F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: a == b), lambda x: x))
    return (
        (~line.rlike(r"\p{Ll}") & (size >= MIN_SHOUT) & line.rlike(r"\p{Lu}"))
        | (bars >= MIN_BARS)
        | (line.rlike(SYMBOLS) & (symbols > MAX_SYMBOLS * size))
        | ((F.size(words) < SHORT_WORDS) & ~line.rlike(ENDING))
        | ((size <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE))
        | ((F.size(words) >= ECHO_WORDS) & (echoes > MAX_ECHO * F.size(words)))
    )


def quality_lines(docs: DataFrame, max_lost: float = MAX_LOST, stats: bool = True) -> DataFrame:
    """docs that keep enough text, with the failing lines removed from text.

    Columns are those of docs, with text and n_chars (where docs has it) renewed, and three more unless stats is false: n_lines
    (non-blank lines before), n_removed, and lost (share of their characters that was removed).

    A null, empty or blank text has nothing to keep and is rejected; a very long one is judged whole, line by line. Blank lines are dropped and count for nothing.
    Equal lines and repeated rows are judged alike; a document that loses just max_lost stays. Columns of docs named n_lines, n_removed or lost are
    replaced by the statistics, and pass through where stats is false; other columns, with nulls in any, pass through. An empty table gives an empty result.
    """
    split = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    pairs = lambda ls: F.transform(ls, lambda x: F.struct(x.alias("x"), F.split(x, " ", -1).alias("w")))
    good = lambda ls: F.transform(F.filter(pairs(ls), lambda z: ~line_fails(z["x"], z["w"])), lambda z: z["x"])
    # A generator of one row: filters on its result stay above it, so that nothing is computed twice.
    j = unused(docs, "judged")
    judged = docs.select("*", F.explode(F.transform(F.array(split), lambda ls: F.struct(ls.alias("all"), good(ls).alias("good")))).alias(j))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    lost = 1 - chars(f"{j}.good") / chars(f"{j}.all")
    kept = judged.where((F.size(f"{j}.good") > 0) & (lost <= max_lost)).withColumn("text", F.array_join(f"{j}.good", "\n"))
    if stats:
        n = F.size(f"{j}.all").cast("long")
        kept = kept.withColumns({"n_lines": n, "n_removed": n - F.size(f"{j}.good").cast("long"), "lost": F.round(lost, 6)})
    out = kept.drop(j)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


QUALITY_SQL = f"""
WITH split AS (
  SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents
), judged AS (
  SELECT *, list_filter(lines, lambda x: NOT (
      (NOT regexp_matches(x, '\\p{{Ll}}') AND length(x) >= {MIN_SHOUT} AND regexp_matches(x, '\\p{{Lu}}'))
      OR ({" + ".join(f"(length(x) - length(replace(x, '{b}', '')))" for b in BARS)}) / 3.0 >= {MIN_BARS}
      OR length(x) - length(regexp_replace(x, {_q(SYMBOLS)}, '', 'g')) > {MAX_SYMBOLS} * length(x)
      OR (len(string_split(x, ' ')) < {SHORT_WORDS} AND NOT regexp_matches(x, {_q(ENDING)}))
      OR (length(x) <= {BOILERPLATE_CHARS} AND regexp_matches(x, {_q(BOILERPLATE)}))
      OR (len(string_split(x, ' ')) >= {ECHO_WORDS}
          AND len(list_filter(list_zip(string_split(x, ' '), string_split(x, ' ')[2:]), lambda z: z[1] = z[2])) > {MAX_ECHO} * len(string_split(x, ' '))))) AS good
  FROM split WHERE len(lines) > 0
), kept AS (
  SELECT *, 1 - CAST(coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS DOUBLE) / list_sum(list_transform(lines, lambda x: length(x))) AS share FROM judged
)
SELECT doc_id, array_to_string(good, chr(10)) AS text, lang, source, length(array_to_string(good, chr(10))) AS n_chars,
       len(lines) AS n_lines, len(lines) - len(good) AS n_removed, round(share, 6) AS lost
FROM kept WHERE share <= {MAX_LOST} AND len(good) > 0
"""
