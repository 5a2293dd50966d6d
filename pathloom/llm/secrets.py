"""Secret scan: two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, one on ordinary identifiers, both from
labelled samples.  A run of token characters whose ratio favours the random
model is a span of kind ``random``, beside the fixed kinds assign, access and
hex, which it never overlaps: they are cut out of the run, and what is left is
judged piece by piece.

Edge cases: a null or empty text has no spans; every text is scanned whole;
repeated rows are scanned one by one; an empty table gives an empty result (and
a model trained on the generated samples alone); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.exprs import SPAN, char_at, count_kind, joined, let, spans_of, text_of

# The base kinds in their order.
_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_PARTS = "^" + _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Characters that the models know; anything else ends a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Row of the table for the state before the first character.
START = len(ALPHABET)


# Words of ordinary identifiers, labelled ordinary beside those of the corpus.
IDENTIFIER_WORDS = (
    "account add array async base block buffer build byte cache call channel check class client close code column command config connect content "
    "context copy count create current data database date debug default delete device document element end engine entry error event field file "
    "filter find format function get group handler hash header height host id image index info init input item key label length level line link "
    "list load local lock log main manager map max message method min mode model module name network new node number object offset open option "
    "order output page parent parser path point position prefix process property query queue range read record reference remove request reset "
    "resource response result return root route row run sample schema score search section send server service session set size sort source "
    "start state status stop storage stream string style system table target task template test text thread time title token total tree type "
    "update upload user util valid value vector version view width window word worker write"
)


@dataclass(frozen=True)
class Model:
    """llr[a * len(ALPHABET) + b]: milli-nats for random over ordinary of b after a."""

    llr: tuple[int, ...]


@dataclass(frozen=True)
class Settings:
    """min_run: shortest candidate. min_llr, per_char: milli-nats needed in all and per character.
    sample_docs: documents whose whole texts give ordinary words. sample_random: digests that give random strings."""

    min_run: int = 20
    min_llr: int = 9000
    per_char: int = 1600
    sample_docs: int = 600
    sample_random: int = 4000
    smoothing: float = 0.5


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """Labelled positives: digests written in four usual encodings."""
    seed = F.col("id").cast("string")
    raw = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), seed), 256))
    mixed = F.regexp_replace(F.base64(raw("m")).cast("string"), "[+/=]", "")
    values = F.array(F.base64(raw("b")).cast("string"), mixed, F.upper(mixed), F.concat(F.lit("k_"), F.lower(mixed)))
    return spark.range(n).select(F.explode(values).alias("value"))


def ordinary_samples(docs: DataFrame, n_docs: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled negatives: identifiers in usual styles, from all words of at most ``n_docs`` documents.

    The documents are those whose key hashes lowest, so the sample does not
    depend on how rows are laid out.
    """
    chosen = docs.select(docs[key].alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(n_docs)
    words = docs.join(F.broadcast(chosen), docs[key] == chosen["k"], "left_semi").select(
        F.filter(F.split(F.coalesce(docs[text], F.lit("")), "[^A-Za-z]+"), lambda w: F.length(w).between(2, 14)).alias("w")
    )
    pair = F.transform(
        F.sequence(F.lit(0), F.size("w") - 2),
        lambda i: F.array(
            F.concat_ws("_", F.lower(F.col("w")[i]), F.lower(F.col("w")[i + 1])),
            F.concat(F.lower(F.col("w")[i]), F.initcap(F.col("w")[i + 1])),
            F.concat_ws("-", F.lower(F.col("w")[i]), F.lower(F.col("w")[i + 1]), (i % 100).cast("string")),
            F.concat_ws("/", F.col("w")[i], F.col("w")[i + 1]),
            F.concat_ws("_", F.upper(F.col("w")[i]), F.upper(F.col("w")[i + 1])),
        ),
    )
    return words.where(F.size("w") >= 2).select(F.explode(F.flatten(pair)).alias("value"))


def identifier_samples(spark: SparkSession) -> DataFrame:
    """Labelled negatives: pairs of the fixed words in usual styles."""
    words = IDENTIFIER_WORDS.split()
    n = len(words)
    pairs = [(words[i], words[(i * k + k) % n]) for i in range(n) for k in (1, 3, 7, 11)]
    values = [v for a, b in pairs for v in (f"{a}_{b}", f"{a}{b.title()}", f"{a}-{b}", f"{a.upper()}_{b.upper()}", f"{a}/{b}_{len(a)}", f"__{a}_{b}__", f"_{a.title()}__{b}")]
    return spark.createDataFrame([(v,) for v in values], "value string")


def train(samples: DataFrame, smoothing: float = 0.5) -> Model:
    """First-order models of both labels from (value, label 1 random / 0 ordinary).

    The counts are summed in Spark; what comes to the driver is one row per
    pair of characters, at most (|alphabet| + 1) * |alphabet| rows.
    """
    n = len(ALPHABET)
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    moves = samples.where(F.length("value") > 0).select(
        "label",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("value")),
                lambda i: F.struct(
                    F.when(i == 1, F.lit(START)).otherwise(code(char_at(F.col("value"), i - 1))).alias("a"),
                    code(char_at(F.col("value"), i)).alias("b"),
                ),
            )
        ).alias("m"),
    )
    counts = (
        moves.where("m.a >= 0 and m.b >= 0")
        .groupBy(F.col("m.a").alias("a"), F.col("m.b").alias("b"))
        .agg(F.sum("label").alias("r"), F.sum(1 - F.col("label")).alias("o"))
        .collect()
    )
    import math

    seen = {(row["a"], row["b"]): (row["r"], row["o"]) for row in counts}
    table = []
    for a in range(n + 1):
        rows = [seen.get((a, b), (0, 0)) for b in range(n)]
        all_r, all_o = (sum(x) + smoothing * n for x in zip(*rows, strict=True))
        table += [round(1000 * (math.log((r + smoothing) / all_r) - math.log((o + smoothing) / all_o))) for r, o in rows]
    return Model(tuple(table))


def ratio(value: Column, model: Model) -> Column:
    """Log-likelihood ratio of a string in milli-nats."""
    n = len(ALPHABET)
    table = F.expr(f"array({','.join(map(str, model.llr))})")
    zero = F.struct(F.lit(START).alias("a"), F.lit(0).cast("bigint").alias("s"))

    def over(t: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            return let(
                F.instr(F.lit(ALPHABET), char_at(value, i)) - 1,
                lambda b: F.struct(b.alias("a"), (acc["s"] + t[acc["a"] * n + b]).alias("s")),
            )

        return F.aggregate(F.sequence(F.lit(1), F.length(value)), zero, step)["s"]

    return let(table, over)


def base_spans(text: Column) -> Column:
    """assign, access and hex spans, each by start."""
    assign = F.filter(spans_of(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_PARTS, 1)) >= 8)
    return F.concat(assign, spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex"))


_CUTS = "struct<at:bigint,parts:array<struct<start:bigint,stop:bigint>>>"


def free_pieces(run: Column, base: Column) -> Column:
    """What the base spans leave of a run, as spans by start."""

    def grown(acc: Column, stop: Column) -> Column:
        part = F.array(F.struct(acc["at"].alias("start"), stop.alias("stop")))
        return F.when(stop > acc["at"], F.concat(acc["parts"], part)).otherwise(acc["parts"])

    met = F.filter(base, lambda o: (o["start"] < run["stop"]) & (run["start"] < o["stop"]))
    bounds = F.sort_array(F.transform(met, lambda o: F.struct(o["start"].alias("start"), o["stop"].alias("stop"))))
    zero = F.struct(run["start"].alias("at"), F.expr("array()").alias("parts")).cast(_CUTS)
    step = lambda acc, o: F.struct(F.greatest(acc["at"], o["stop"]).alias("at"), grown(acc, o["start"]).alias("parts")).cast(_CUTS)
    parts = F.aggregate(bounds, zero, step, lambda acc: grown(acc, run["stop"]))
    value = lambda p: F.substr(run["value"], (p["start"] - run["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int"))
    return F.transform(parts, lambda p: F.struct(run["kind"].alias("kind"), p["start"].alias("start"), p["stop"].alias("stop"), value(p).alias("value")).cast(SPAN))


def random_spans(text: Column, base: Column, model: Model, settings: Settings) -> Column:
    """Runs, or what base spans leave of them, that the random model explains better."""
    run = f"[A-Za-z0-9+/_=-]{{{settings.min_run},}}"
    free = F.flatten(F.transform(spans_of(text, run, "random"), lambda s: free_pieces(s, base)))
    long = F.filter(free, lambda s: s["stop"] - s["start"] >= settings.min_run)
    return F.filter(
        long,
        lambda s: let(ratio(s["value"], model), lambda r: (r >= settings.min_llr) & (r >= F.length(s["value"]) * settings.per_char)),
    )


def in_order(spans: Column) -> Column:
    """By start, then assign, access, hex, random."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "random"))), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), rank(s).alias("rank"), s.alias("span")))
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def find_secrets(docs: DataFrame, model: Model, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and found (all) spans of every row: one narrow stage."""
    body = docs.select(docs[key].alias(key), text_of(docs, text).alias("__text"))
    body = body.select(key, "__text", in_order(base_spans(F.col("__text"))).alias("base"))
    return body.select(
        key,
        "base",
        let(
            F.concat(F.col("base"), random_spans(F.col("__text"), F.col("base"), model, settings)),
            in_order,
        ).alias("found"),
    )


def redacted(text: Column, model: Model, settings: Settings = Settings(), mark: str = "[secret]") -> Column:
    """The text with every span of a secret replaced by ``mark``; overlapping spans count as one."""

    def cut(spans: Column, body: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            grown = F.concat(acc["parts"], F.array(gap, F.lit(mark)))
            return (
                F.when(s["stop"] <= acc["at"], acc)
                .when(s["start"] < acc["at"], F.struct(s["stop"].alias("at"), acc["parts"].alias("parts")))
                .otherwise(F.struct(s["stop"].alias("at"), grown.alias("parts")))
            )

        rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(body, (acc["at"] + 1).cast("int")))
        return let(F.aggregate(spans, zero, step), rest)

    def found(body: Column) -> Column:
        return let(base_spans(body), lambda b: in_order(F.concat(b, random_spans(body, b, model, settings))))

    return let(text, lambda body: let(found(body), lambda spans: F.when(F.size(spans) == 0, body).otherwise(cut(spans, body))))


def default_model(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Trained on generated digests and on identifiers from a bounded sample of documents."""
    samples = random_samples(docs.sparkSession, settings.sample_random).withColumn("label", F.lit(1))
    ordinary = ordinary_samples(docs, settings.sample_docs).unionByName(identifier_samples(docs.sparkSession)).withColumn("label", F.lit(0))
    return train(samples.unionByName(ordinary), settings.smoothing)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, default_model(docs))
    return found.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count_kind(F.col("found"), "random").alias("n_random"),
    )
