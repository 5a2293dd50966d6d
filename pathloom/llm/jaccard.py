"""N-gram Jaccard self-join of documents by grouped prefixes.

A document's set is its distinct k-word shingles, as 64-bit hashes of which
words of up to eight bytes are exact keys.  Two documents link when the Jaccard
similarity of their sets reaches the limit; every link between different texts
is decided on their words, not on hashes.

1. Shingle frequencies are counted in buckets, whose number follows the size of
   the texts within bounds; they give one global order, rare shingles first (any
   fixed order is exact, a rare-first one keeps posting lists short).
2. A set's prefix is as many of its first shingles as two linked sets must
   share one of.  Documents with equal prefix and size form a group, and
   groups, not documents, stand in the posting lists.  Lists are dealt out by
   ranges of (shingle, order), so that one of any length spreads over tasks.
3. Round one takes neighbours in each list, in one of a few mixed orders;
   round two pairs groups with the one of the list that has most links by then,
   and in lists of large components with a few more;
   round three takes all pairs of groups that are not connected after those.
   Pairs are filtered by size, by position, by shared prefix shingles and by an
   exact bound from parity bitmaps; groups are expanded to their different
   word sequences, and those are verified on whole texts.  Pairs that are connected
   already cannot change a component, so a large group of near copies costs a
   few chains and a star, not its square.
4. Components come from alternating stars.

Edge cases: null or empty texts have no shingles, n_shingles 0, and are their
own component; texts of fewer than k words have one shingle, the whole; copies
share one set; rows with the same doc_id are one node; rows with a null doc_id
take the component of their set (null if no row of it has an id); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm import textkernel as kernel
from pathloom.llm.components import components
from pathloom.llm.hashcounts import hash_counts
from pathloom.llm.storage import saved


@dataclass(frozen=True)
class Settings:
    """k: words of a shingle. percent: least similarity. bits, most_bits: log2 of frequency buckets, at least and at most
    (a byte each is sent to all). id_bits: log2 of the id filter's bits. slot: rows of a list that one window orders, about.
    task_rows: rows of posting lists in a task, about."""

    k: int = 5
    percent: int = 75
    bits: int = 22
    most_bits: int = 26
    id_bits: int = 22
    slot: int = 128
    task_rows: int = 1_000_000


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(t or "").encode().lower() for t in column.to_pylist()]


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    for _, some in kernel.chunks(texts):
        hashes, at = kernel.word_hashes(some)
        for i in range(len(some)):
            yield kernel.shingles(hashes[at[i] : at[i + 1]], k)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of n that cannot all be missing from a set that links."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _fold(values: np.ndarray, size: int) -> int:
    """A 64-bit digest of an array and a number."""
    return int.from_bytes(kernel.digest(values.tobytes() + size.to_bytes(8, "little")), "little", signed=True)


def parity_bitmap(shingles: np.ndarray) -> list[int]:
    """Parity of the number of shingles per bucket, in the least power of two of bits over twice their number, 256 at least."""
    bits = max(256, 1 << int(2 * max(len(shingles), 1)).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def overlap_bound(x: Column, nx: Column, y: Column, ny: Column) -> Column:
    """The most shingles that both sets can share: each set bit of the difference is a shingle in one of them only.

    The longer bitmap is folded onto the shorter, which halves it; sizes near
    each other need that once at most, and other pairs are bounded by the
    smaller set.
    """
    half = lambda b: F.zip_with(F.slice(b, F.lit(1), (F.size(b) / 2).cast("int")), F.slice(b, (F.size(b) / 2).cast("int") + 1, (F.size(b) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    a = F.when(F.size(x) == 2 * F.size(y), half(x)).otherwise(x)
    b = F.when(F.size(y) == 2 * F.size(x), half(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return F.when((F.size(x) > 2 * F.size(y)) | (F.size(y) > 2 * F.size(x)), F.least(nx, ny)).otherwise(((nx + ny - apart) / 2).cast("bigint"))


def enough(overlap: Column | int, nx: Column | int, ny: Column | int, percent: int):
    """Whether an overlap of sets of these sizes reaches the similarity."""
    return overlap * (100 + percent) >= (nx + ny) * percent


#: Different orders of posting lists.
ORDERS = 4
#: Links of a list's best linked group from which on its groups also try others in round two.
CROWD = 4
#: How far before a group those stand in the list's mixed order.
STEPS = (1, 2, 4, 8)


class _Order:
    """Rare-first order of shingles, from the broadcast bucket levels."""

    def __init__(self, levels, bits: int, settings: Settings) -> None:
        self.levels, self.bits, self.settings = levels, bits, settings

    def ordered(self, shingles: np.ndarray) -> np.ndarray:
        level = np.frombuffer(self.levels.value, np.uint8)[(shingles >> np.uint64(64 - self.bits)).astype(np.int64)]
        return shingles[np.argsort((level.astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8)), kind="stable")]

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        return self.ordered(shingles)[: prefix_length(len(shingles), self.settings.percent)]


def bucket_bits(docs: DataFrame, settings: Settings) -> int:
    """log2 of the frequency buckets: some 32 words, of six letters each, share one, within the bounds."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return min(settings.most_bits, max(settings.bits, (chars // (6 * 32)).bit_length()))


def frequency_levels(docs: DataFrame, bits: int, settings: Settings) -> bytes:
    """Half-octave frequency level of every bucket, over all documents: 2**bits bytes."""
    k = settings.k

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, size = [], 0
        for s in _sets(_texts(batch.column(0)), k):
            held.append(s)
            size += len(s)
            if size > 1_000_000:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    return hash_counts(docs.select("text"), hashes, bits, lambda n: np.minimum(2 * np.log2(n + 1), 255).astype(np.uint8)).tobytes()


def described(docs: DataFrame, order: _Order) -> DataFrame:
    """doc_id, n, gk (prefix and size), sk (set), qk (words in their order), parity bitmap and prefix of every row."""
    k = order.settings.k
    kinds = {"n": pa.int64(), "gk": pa.int64(), "sk": pa.int64(), "qk": pa.binary(), "bits": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            out: dict[str, list] = {c: [] for c in kinds}
            for s, text in zip(_sets(texts, k), texts, strict=True):
                prefix = order.prefix(s)
                out["n"].append(len(s))
                out["gk"].append(_fold(prefix, len(s)))
                out["sk"].append(_fold(s, len(s)))
                out["qk"].append(kernel.digest(b" ".join(text.split()), 16))
                out["bits"].append(parity_bitmap(s))
                out["prefix"].append(prefix.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], t) for c, t in kinds.items())], names=["doc_id", *kinds])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, gk long, sk long, qk binary, bits array<long>, prefix array<long>")


def neighbours(rows: DataFrame, key: str, other: str, order: list[Column], carried: list[str], tasks: int) -> DataFrame:
    """Rows whose ``key`` has at least two values of ``other``, one for each value, with the columns ``carried`` of the row before.

    Rows are dealt out by ranges of the order, so that a key with very many
    rows spreads over tasks; at the border of two tasks a row may be without
    the one before, and rows there are kept in any case.
    """
    columns = list(dict.fromkeys([key, other, *carried]))
    places = [F.col(key), *order, F.col(other)]
    named = rows.select(*columns, *(c.alias(f"__{i}") for i, c in enumerate(places[1:-1])))
    by = [F.col(key), *(F.col(f"__{i}") for i in range(len(order))), F.col(other)]
    dealt = named.repartitionByRange(tasks, *by).sortWithinPartitions(*by).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and the one before that it was compared with

        def pairs(table: pa.Table, first: bool, last: bool) -> pa.RecordBatch | None:
            """Of all rows but the first (already told) and, unless it is the end, the last."""
            k, o = table[key].to_numpy(), table[other].to_numpy()
            same = k[1:] == k[:-1]
            near = np.zeros(len(k), dtype=bool)
            near[1:] |= same
            near[:-1] |= same
            if first:
                near[0] = True
            if last:
                near[-1] = True
            before = np.concatenate(([False], same))
            at = np.flatnonzero(near)
            at = at[(at > 0) | first]
            at = at[(at < len(k) - 1) | last]
            if not len(at):
                return None
            own = table.take(pa.array(at))
            prior = table.take(pa.array(np.maximum(at - 1, 0)))
            none = pa.array(~before[at])
            import pyarrow.compute as pc

            cols = [own[c].combine_chunks() for c in columns] + [pc.if_else(none, pa.scalar(None, prior[c].type), prior[c].combine_chunks()) for c in carried]
            return pa.RecordBatch.from_arrays(cols, names=[*columns, *(f"p_{c}" for c in carried)])

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            k, o = table[key].to_numpy(), table[other].to_numpy()
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
            if not fresh.all():
                table = table.filter(pa.array(fresh))
            if table.num_rows > (1 if first else 2):
                got = pairs(table, first, False)
                if got is not None:
                    yield got
                first = False
                held = table.slice(table.num_rows - 2)
            else:
                held = table
        if held is not None:
            got = pairs(held, first, True)
            if got is not None:
                yield got

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join([f"{c} {kinds[c]}" for c in columns] + [f"p_{c} {kinds[c]}" for c in carried])
    return dealt.mapInArrow(run, schema)


def task_count(rows: DataFrame, settings: Settings) -> int:
    """Tasks for a saved table of posting lists."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // settings.task_rows + 1)


def shared_lists(groups: DataFrame, settings: Settings) -> DataFrame:
    """(token, gk, n, pos) of tokens in the prefixes of at least two groups, with the group before in the list's order.

    The order is one of ORDERS mixed ones within bands of size: equal orders
    everywhere would give a large group of near copies the same neighbours in
    all of its lists.
    """
    posts = groups.select("gk", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    band = F.floor(F.log("n") * 8)  # sizes near each other stay together
    tokens = groups.agg(F.sum(F.size("prefix")).alias("t")).first()["t"] or 0
    tasks = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // settings.task_rows + 1)
    return neighbours(posts, "token", "gk", [band, F.xxhash64("gk", F.pmod("token", F.lit(ORDERS)))], ["gk", "n", "pos"], tasks)


def near_sizes(nx: Column, ny: Column, percent: int) -> Column:
    return F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent


def group_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups from meetings (x, y, nx, ny, px, py) in posting lists, filtered by the tokens shared.

    Beyond the last shared prefix token only the rests of both sets can meet.
    ``met`` need not hold every meeting of a pair: then the bound is taken from
    the first of those held, which is no smaller.
    """
    ok = met.where(near_sizes(F.col("nx"), F.col("ny"), percent) & enough(1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1, F.col("nx"), F.col("ny"), percent))
    return ok.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.count(F.lit(1)).alias("c"), F.max("px").alias("px"), F.max("py").alias("py"))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set ids whose bitmaps allow the similarity."""

    one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    two = one.join(sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    near = two.where(near_sizes(F.col("na"), F.col("nb"), percent))
    bound = overlap_bound(F.col("xa"), F.col("na"), F.col("xb"), F.col("nb"))
    return near.where(enough(bound, F.col("na"), F.col("nb"), percent)).select("a", "b")


def _id_hash(values: np.ndarray) -> np.ndarray:
    return kernel.mix(values.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


def texts_of(docs: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """(id, text) of the documents in ``ids`` (column id).

    A bitmap of fixed size over hashed ids drops most other rows before the
    join; what it lets through by chance the join drops.
    """
    bits = settings.id_bits
    counts = hash_counts(ids.select("id"), lambda b: iter([_id_hash(b.column(0).to_numpy(zero_copy_only=False))]), bits, lambda n: n > 0)
    filter_bits = ids.sparkSession.sparkContext.broadcast(np.packbits(counts).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(filter_bits.value, np.uint8)).astype(bool)
        for batch in batches:
            at = (_id_hash(batch.column(0).to_numpy(zero_copy_only=False)) >> np.uint64(64 - bits)).astype(np.int64)
            yield batch.filter(pa.array(table[at]))

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, text string")
    return some.join(ids.distinct(), "id", "left_semi")


def overlap(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """(shingles in common, of a, of b) of two sequences of word numbers, without hashes."""
    width = min(len(a), k)
    if not width or width != min(len(b), k):
        return 0, 0, 0
    known, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, m = code[: len(a)], code[len(a) :], len(known)
    p, q, most = x[: len(a) - width + 1], y[: len(b) - width + 1], m
    for j in range(1, width):
        if most * m >= 1 << 62:
            known, code = np.unique(np.concatenate([p, q]), return_inverse=True)
            p, q, most = code[: len(p)], code[len(p) :], len(known)
        p, q, most = p * m + x[j : len(a) - width + 1 + j], q * m + y[j : len(b) - width + 1 + j], most * m
    p, q = np.unique(p), np.unique(q)
    return len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)


def _verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) whose whole texts reach the similarity, word for word."""
    k, percent = settings.k, settings.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}

        def words(text: bytes) -> np.ndarray:
            return np.array([number.setdefault(w, len(number)) for w in text.split()], dtype=np.int64)

        last: tuple[bytes, np.ndarray] | None = None  # rows come with equal second texts together
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = _texts(batch.column(2)), _texts(batch.column(3))
            keep = []
            for i in range(len(a)):
                if len(number) > 1_000_000:
                    number.clear()
                    last = None
                if last is None or last[0] != tb[i]:
                    last = (tb[i], words(tb[i]))
                both, x, y = overlap(words(ta[i]), last[1], k)
                if both and enough(both, x, y, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, settings: Settings, name: str) -> DataFrame:
    """Verified pairs of set ids, written to the shared folder."""
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    near = saved(_bounded(pairs, sets, settings.percent), f"{name}-near")
    if near.isEmpty():
        return near
    ids = near.select(F.explode(F.array("a", "b")).alias("id"))
    texts = saved(texts_of(docs, ids, settings), f"{name}-texts")
    return saved(_verified(near, texts, settings), f"{name}-links")


def link_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id of every row of ``docs`` (doc_id, text)."""
    spark, percent = docs.sparkSession, settings.percent
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    bits = bucket_bits(docs, settings)
    order = _Order(spark.sparkContext.broadcast(frequency_levels(docs, bits, settings)), bits, settings)
    rows = saved(described(docs, order), "jaccard-rows")
    named = rows.where("n > 0 and doc_id is not null")
    sets = saved(named.groupBy("n", "gk", "sk", "qk").agg(F.min("doc_id").alias("sid"), F.first("bits").alias("bits")), "jaccard-sets")
    groups = saved(named.groupBy("gk", "n").agg(F.first("prefix").alias("prefix")), "jaccard-groups")
    lists = saved(shared_lists(groups, settings), "jaccard-lists")

    def member_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        return pairs.join(left, "x").join(right, "y").select("a", "b")

    # Round one: neighbours in posting lists, and in groups of several sets.
    chain = group_pairs(lists.where("p_gk is not null").select(
        F.col("gk").alias("x"), F.col("p_gk").alias("y"), F.col("n").alias("nx"), F.col("p_n").alias("ny"), F.col("pos").alias("px"), F.col("p_pos").alias("py")
    ), percent).select("x", "y")
    reps = sets.groupBy("gk").agg(F.min("sid").alias("sid"))
    between = member_pairs(chain, reps.select(F.col("gk").alias("x"), F.col("sid").alias("a")), reps.select(F.col("gk").alias("y"), F.col("sid").alias("b")))
    within = neighbours(sets, "gk", "sid", [], ["sid"], task_count(sets, settings)).where("p_sid is not null").select(F.col("sid").alias("a"), F.col("p_sid").alias("b"))
    first = _links(between.unionByName(within), docs, sets, settings, "jaccard-1")

    # Round two: the best linked group of each list with the others there that it is not connected to.
    def connected(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Members of groups with their components, and the posting lists that hold different ones."""
        members = saved(
            sets.select("gk", "n", "sid").join(found.withColumnRenamed("node", "sid"), "sid", "left").select("gk", "sid", F.coalesce("component", "sid").alias("comp")),
            f"{name}-members",
        )
        kinds = members.groupBy("gk", "comp").agg(F.min("sid").alias("sid"))
        held = lists.select("token", "gk", "n", "pos").join(kinds, "gk")
        differ = held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
        # Written, so that the join has two dealt sides, of which a hot token's can be split.
        return members, saved(held.join(saved(differ, f"{name}-differ"), "token", "left_semi"), f"{name}-mixed")

    found = components(first)
    members, mixed = connected(found, "jaccard-1")
    degree = first.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    rated = saved(mixed.join(degree, "sid", "left"), "jaccard-rated")
    entry = F.struct("links", "gk", "n", "pos", "comp", "sid")
    hubs = rated.groupBy("token").agg(F.max(entry).alias("hub"), F.count(F.lit(1)).alias("rows")).where("hub.links is not null")
    rated = rated.join(saved(hubs, "jaccard-hubs"), "token").withColumn("slot", F.pmod(F.xxhash64("token", "gk"), F.ceil(F.col("rows") / settings.slot)))
    rated = rated.repartition("token", "slot")  # else the join's partitions, by token, would serve the window
    shuffled = Window.partitionBy("token", "slot").orderBy(F.xxhash64("gk", "token"), "gk", "comp")
    before = {f"before{i}": F.when(F.col("hub.links") >= CROWD, F.lag(entry, i).over(shuffled)) for i in STEPS}
    spokes = rated.withColumns(before).select("sid", "n", "pos", "comp", F.explode(F.array("hub", *before)).alias("o")).where(F.col("comp") != F.col("o.comp")).select(
        F.col("sid").alias("x"), F.col("o.sid").alias("y"), F.col("n").alias("nx"), F.col("o.n").alias("ny"), F.col("pos").alias("px"), F.col("o.pos").alias("py")
    )
    star = _links(group_pairs(spokes, percent).select(F.col("x").alias("a"), F.col("y").alias("b")), docs, sets, settings, "jaccard-2")
    linked = lambda known, more: components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    if not star.isEmpty():
        found = linked(found, star)
        members, mixed = connected(found, "jaccard-2")

    # Round three: pairs of groups that hold different components.
    left = mixed.select("token", *(F.col(c).alias(f"{c}1") for c in ("gk", "n", "pos", "comp")))
    right = mixed.select("token", *(F.col(c).alias(f"{c}2") for c in ("gk", "n", "pos", "comp")))
    room = 1 + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) - 1
    met = left.join(right, "token").where(
        (F.col("gk1") < F.col("gk2")) & (F.col("comp1") != F.col("comp2")) & near_sizes(F.col("n1"), F.col("n2"), percent) & enough(room, F.col("n1"), F.col("n2"), percent)
    )
    pairs = met.groupBy("gk1", "gk2", "comp1", "comp2").agg(
        F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.count(F.lit(1)).alias("c"), F.max("pos1").alias("pos1"), F.max("pos2").alias("pos2")
    )
    pairs = pairs.where(enough(F.col("c") + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) - 1, F.col("n1"), F.col("n2"), percent))
    one, two = (members.select(F.col("gk").alias(f"gk{i}"), F.col("comp").alias(f"comp{i}"), F.col("sid").alias(s)) for i, s in ((1, "a"), (2, "b")))
    across = pairs.join(one, ["gk1", "comp1"]).join(two, ["gk2", "comp2"]).select("a", "b")
    inside = one.join(two, F.col("gk1") == F.col("gk2")).where("comp1 < comp2").select("a", "b")
    second = _links(across.unionByName(inside), docs, sets, settings, "jaccard-3")

    if not second.isEmpty():
        found = linked(found, second)
    same = sets.groupBy("n", "gk", "sk").agg(F.min("sid").alias("set_id"))
    classes = sets.select("n", "gk", "sk", "qk", "sid").join(found.withColumnRenamed("node", "sid"), "sid", "left").join(same, ["n", "gk", "sk"]).select(
        "n", "gk", "sk", "qk", "set_id", F.coalesce("component", "sid").alias("component")
    )
    return rows.select("doc_id", "n", "gk", "sk", "qk").join(classes, ["n", "gk", "sk", "qk"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("set_id", "doc_id").alias("set_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over the whole ``documents`` table."""
    return link_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, CAST(len(w) - 3 AS BIGINT))]) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS set_id FROM g),
p AS (SELECT doc_id, unnest(s) AS x FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM p a JOIN p b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.set_id FROM n JOIN reach ON reach.node = n.doc_id GROUP BY ALL
"""
