"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words, as a Java class body.
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``.

    The optimiser may paste an expression into a lambda, where it would be
    evaluated again for every element; a lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(df[column], F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, in order."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; no other character changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


SPAN = "struct<kind:string,start:bigint,stop:bigint,value:string>"
_STATE = f"struct<at:bigint,found:array<{SPAN}>>"
_BLOCKS = f"struct<at:bigint,found:array<array<{SPAN}>>>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def spans_of(text: Column, pattern: str, kind: str, block: int = 256) -> Column:
    """All leftmost non-overlapping matches as array<struct<kind,start,stop,value>>.

    Positions count code points. Matches and the gaps between them come from
    one extraction and one split by the same pattern, so a running sum of
    lengths gives the offsets.  The sum runs in blocks, so that a text with
    very many matches costs in proportion to them, not to their square.
    ``pattern`` must not match the empty string.
    """

    def step(acc: Column, pair: Column) -> Column:
        def grown(x: Column) -> Column:
            span = F.struct(F.lit(kind).alias("kind"), x["b"].alias("start"), x["e"].alias("stop"), pair["hit"].alias("value"))
            return F.struct(x["e"].alias("at"), F.concat(acc["found"], F.array(span.cast(SPAN))).alias("found")).cast(_STATE)

        begin = acc["at"] + F.length(pair["gap"])
        return let(F.struct(begin.alias("b"), (begin + F.length(pair["hit"])).alias("e")), grown)

    def block_step(acc: Column, pairs: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), no_spans().alias("found")).cast(_STATE)
        return let(
            F.aggregate(pairs, zero, step),
            lambda x: F.struct(x["at"].alias("at"), F.concat(acc["found"], F.array(x["found"])).alias("found")).cast(_BLOCKS),
        )

    def offsets(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
        blocks = let(
            pairs,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.floor((F.size(p) - 1) / block).cast("int")), lambda b: F.slice(p, b * block + 1, F.lit(block))
            ),
        )
        zero = F.expr(f"cast(struct(0L, array()) as {_BLOCKS})")
        return F.flatten(F.aggregate(blocks, zero, block_step)["found"])

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), offsets)).otherwise(no_spans())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def clear_of(span: Column, others: Column) -> Column:
    """True where the span overlaps none of the others."""
    return ~F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def char_at(value: Column, i: Column) -> Column:
    return F.substr(value, i, F.lit(1))
