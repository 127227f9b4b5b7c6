"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Everything is SQL functions over one row: the text is cut into words and lines, and arrays are folded where they
stand. There is no shuffle and no Python. Windows of words are compared by 64-bit hashes of the words in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
SPACE = "[\\x20\\x09-\\x0D]"
#: Words in a repeated window; fewest words; most repeated words in a hundred.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: A line of this many words or more must end in closing punctuation, unless it is the last of the text.
PROSE_WORDS = 40
#: Share of a line's words that may carry symbols; most links or separators in a short line.
SYMBOL_SHARE, MAX_SEPARATORS = 0.3, 3
#: A document must keep this share of its characters.
KEEP_SHARE = 0.5

#: Phrases of page furniture (fixed values).
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in",
    "privacy policy",
    "read more",
    "share this",
    "sign up",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of size words (a power of two) which the text has twice or more."""
    def doubled(by: int) -> Callable[[Column], Column]:
        """From hashes of by words, at every word, those of twice as many; the last ones are cut short."""
        return lambda h: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    def hashed(h: Column) -> Column:
        steps, by = h, 1
        while by < size:
            steps, by = let(steps, doubled(by)), 2 * by
        return let(steps, lambda x: F.slice(x, 1, F.size(x) - (size - 1)))

    def pairs(ordered: Column) -> Column:
        both = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.struct(a["i"].alias("a"), b["i"].alias("b"), (a["h"] == b["h"]).alias("same")))
        return F.filter(both, lambda p: p["same"])

    def covered(found: Column) -> Column:
        at = F.array_sort(F.array_distinct(F.concat(F.transform(found, lambda p: p["a"]), F.transform(found, lambda p: p["b"]))))
        return let(at, lambda s: F.aggregate(s, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).cast("long").alias("n"), i.alias("last")), lambda acc: acc["n"]))

    def count(windows: Column) -> Column:
        numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(let(F.sort_array(numbered), pairs))).otherwise(F.lit(0).cast("long"))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(F.size(words) > size, let(windows, count)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column, last: Column) -> Column:
    """A line without words never fails. Rules: mostly symbols, runs of separators between few words (navigation),
    boilerplate phrases in a short line, and a long line that breaks off without punctuation before the last line."""
    marks = let(
        F.struct(
            F.size(F.split(F.trim(F.regexp_replace(line, SPACE + "+", " ")), " ", -1)).alias("words"),
            F.regexp_count(line, F.lit("[#*$%&|<>](?=[\\x20\\x09-\\x0D]|\\z)")).alias("symbols"),
            F.regexp_count(line, F.lit("(?<![^\\x20\\x09-\\x0D])[|>»•·](?![^\\x20\\x09-\\x0D])")).alias("separators"),
        ),
        lambda m: (m["symbols"] > SYMBOL_SHARE * m["words"])
        | ((m["separators"] >= MAX_SEPARATORS) & (m["words"] < 8 * (m["separators"] + 1)))
        | ((m["words"] <= 12) & F.lower(line).rlike("(?:^|[^a-z0-9])(?:" + "|".join(BOILERPLATE) + ")(?:[^a-z0-9]|\\z)"))
        | ((m["words"] >= PROSE_WORDS) & ~last & ~line.rlike("[.!?:;,\"'”»)\\]…][\\x20\\x09-\\x0D]*\\z")),
    )
    return line.rlike("[^\\x20\\x09-\\x0D]") & marks


def clean_lines(text: Column) -> Column:
    """text without its failing lines."""
    return let(F.split(text, "\n", -1), lambda lines: F.array_join(F.filter(lines, lambda x, i: ~line_fails(x, i + 1 == F.size(lines))), "\n"))


def line_quality(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) as doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, kept_text.

    A null text has no words and fails; so does an empty one. kept_text is the cleaned text of a kept document, else
    null. Repeated rows each get their answer; other columns of docs don't matter, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    words = F.filter(F.split("t", SPACE + "+", -1), lambda w: w != "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    many = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    found = rows.select(
        "doc_id",
        "t",
        counted.alias("c"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        many.alias("n_dup_lines"),
    )
    failed = (F.col("c.n") < MIN_WORDS) | (100 * F.col("c.r") > MAX_REPEATED * F.col("c.n"))
    cleaned = F.when(~failed, clean_lines(F.col("t")))
    kept = F.coalesce(F.length("clean") >= KEEP_SHARE * F.length("t"), F.lit(False))
    return (
        found.select("doc_id", "t", F.col("c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.r").alias("n_repeat_words"), failed.alias("base_failed"), cleaned.alias("clean"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(kept, F.col("clean")).alias("kept_text"))
    )


#: The base counts and the rules in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT k, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM p) WHERE n > 1),
c AS (SELECT k, sum(least(8, coalesce(i - before, 8))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM r) GROUP BY k),
l AS (SELECT k, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i, len(string_split(t, chr(10))) AS n FROM d),
m AS (SELECT k, i, n, line,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
  len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '[#*$%&|<>]$'))) AS symbols,
  len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x IN ('|', '>', '»', '•', '·'))) AS seps,
  regexp_matches(lower(line), '(?:^|[^a-z0-9])(?:BOILER)(?:[^a-z0-9]|$)') AS furniture,
  regexp_matches(line, '[.!?:;,"''”»)\]…][\x20\x09-\x0D]*$') AS closed FROM l),
f AS (SELECT *, words > 0 AND (symbols > 0.3 * words OR (seps >= 3 AND words < 8 * (seps + 1)) OR (words <= 12 AND furniture) OR (words >= 40 AND i < n AND NOT closed)) AS bad FROM m),
g AS (SELECT k, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS dup,
  coalesce(sum(length(line)) FILTER (NOT bad), 0) + greatest(count(*) FILTER (NOT bad) - 1, 0) AS left_chars FROM f GROUP BY k),
a AS (SELECT doc_id, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, left_chars, length(t) AS chars
  FROM d JOIN w USING (k) LEFT JOIN c USING (k) LEFT JOIN g USING (k))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars >= 0.5 * chars AS kept
FROM a""".replace("BOILER", "|".join(BOILERPLATE))
