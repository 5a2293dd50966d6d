"""Quality rules: line-first cleaning, as native DataFrame expressions.

``line_first`` looks at every line of a text, removes lines that fail a rule,
and keeps a document unless its base counts fail or cleaning takes too much.

Edge cases: a null or empty text has no words, fails the base counts and is
not kept; a text without line breaks is one line; repeated rows are judged one
by one; an empty table gives an empty result; columns of the input other than
the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.exprs import SPACE, let, text_of, words_of

SYMBOLS = "#*$%&|<>"

# Phrases that mark a line as page furniture, in lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign up now",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document verdict."""

    min_words: int = 50
    max_repeat_percent: int = 50
    nav_bars: int = 3
    symbol_percent: int = 8
    shout_words: int = 3
    unpunctuated_words: int = 8
    max_lost_percent: int = 50


def repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found at least twice.

    Windows are compared by a 64-bit hash.  Only texts in which a window
    repeats pay for the sort that finds the positions.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(
                s,
                lambda e, i: F.when(i > 0, s[F.greatest(i - 1, F.lit(0))]["h"] == e["h"]).otherwise(F.lit(False))
                | F.when(i < F.size(s) - 1, s[F.least(i + 1, F.size(s) - 1)]["h"] == e["h"]).otherwise(F.lit(False)),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, twice))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), covered))).cast("bigint")


def bad_line(line: Column, rules: Rules) -> Column:
    """Navigation, symbol noise, shouting, boilerplate or prose without a stop."""
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    n_words = F.size(F.split(line, f"[{SPACE}]+"))
    return (
        (bars >= rules.nav_bars)
        | (symbols * 100 > F.length(line) * rules.symbol_percent)
        | ((line == F.upper(line)) & (line != F.lower(line)) & (n_words >= rules.shout_words))
        | F.lower(line).rlike("|".join(BOILERPLATE))
        | ((~line.rlike("[.!?:;…。！？]")) & (n_words >= rules.unpunctuated_words))
    )


def cleaned(text: Column, rules: Rules) -> Column:
    """struct<n_dup_lines, n_chars, lost, lines>; lost counts characters of lines removed."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))

    def judged(all_lines: Column) -> Column:
        def with_unique(unique: Column) -> Column:
            good = F.filter(unique, lambda line: ~bad_line(line, rules))
            return let(
                good,
                lambda g: F.struct(
                    (F.size(all_lines) - F.size(unique)).cast("bigint").alias("n_dup_lines"),
                    F.length(F.array_join(all_lines, "")).cast("bigint").alias("n_chars"),
                    (F.length(F.array_join(all_lines, "")) - F.length(F.array_join(g, ""))).cast("bigint").alias("lost"),
                    g.alias("lines"),
                ),
            )

        return let(F.array_distinct(all_lines), with_unique)

    return let(lines, judged)


def line_first(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, verdict and cleaned text of every row: one narrow stage, no shuffle."""
    body = text_of(docs, text)
    base = docs.select(docs[key].alias(key), body.alias("__text")).select(
        key,
        let(
            words_of(F.col("__text")),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.size(F.regexp_extract_all(F.col("__text"), F.lit(f"[{SYMBOLS}]"), F.lit(0))).cast("bigint").alias("n_symbols"),
        cleaned(F.col("__text"), rules).alias("c"),
    )
    failed = (F.col("w.n_words") < rules.min_words) | (F.col("w.n_repeat_words") * 100 > F.col("w.n_words") * rules.max_repeat_percent)
    lost_too_much = F.col("c.lost") * 100 > F.col("c.n_chars") * rules.max_lost_percent
    return base.select(
        key,
        F.col("w.n_words").alias("n_words"),
        F.col("w.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("c.n_dup_lines").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~lost_too_much).alias("kept"),
        F.col("c.lost").alias("lost_chars"),
        F.array_join(F.col("c.lines"), "\n").alias("clean_text"),
    )


def keeps(text: Column, rules: Rules = Rules()) -> Column:
    """The verdict on one text as a column, for use as a filter."""
    body = F.coalesce(text, F.lit(""))
    failed = let(
        words_of(body),
        lambda w: F.when(F.size(w) < rules.min_words, F.lit(True)).otherwise(repeat_words(w) * 100 > F.size(w) * rules.max_repeat_percent),
    )
    return F.when(failed, F.lit(False)).otherwise(let(cleaned(body, rules), lambda c: c["lost"] * 100 <= c["n_chars"] * rules.max_lost_percent))


def query(spark, sf_dir: str) -> DataFrame:
    """op6 over the whole ``documents`` table."""
    return line_first(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("clean_text")


_BAD = (
    "(length(line) - length(replace(line, '|', '')) >= 3"
    " OR (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 100 > length(line) * 8"
    " OR (line = upper(line) AND line <> lower(line) AND len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) >= 3)"
    f" OR regexp_matches(lower(line), '{'|'.join(BOILERPLATE)}')"
    " OR (NOT regexp_matches(line, '[.!?:;…。！？]') AND len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) >= 8))"
)

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lt AS (SELECT doc_id, count(*) AS n, sum(length(line)) AS chars FROM lw GROUP BY doc_id),
lu AS (SELECT DISTINCT doc_id, line FROM lw),
lg AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN {_BAD} THEN 0 ELSE length(line) END) AS good FROM lu GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lt.n - lg.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lt.chars - lg.good, 0) AS BIGINT) AS lost_chars, coalesce(lt.chars, 0) AS chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lt USING (doc_id) LEFT JOIN lg USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost_chars * 100 > chars * 50) AS kept, lost_chars
FROM b
"""
