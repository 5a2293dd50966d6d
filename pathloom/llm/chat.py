r"""Chat formatting by schema fingerprints.

Records are variants of any layout: rows of single turns, lists of messages,
prompts with answers, instructions with inputs.  The nested field paths of a
record are hashed; the hash selects a declarative mapping, which is a column
expression, and gives canonical turns (role, text).  A template marks the turns.
Control strings inside roles and texts get a break behind their first character,
so that none of them stands in a text, and the escape character is doubled; both
can be undone.

Turns are dealt out by ranges of (key, order), so a conversation of any length
spreads over tasks, and are written as fragments of bounded size in order, each
with the spans of the loss mask.  ``turns_of`` reads fragments back.

Edge cases: a null text or role is empty; a record that is null, not JSON, or
without a mapping has a fingerprint and no turns; an empty list of messages has
no turns; rows with a null key are one conversation; turns of one key and order
come by role and text, repeated ones stay; an empty table has no fragments;
other columns, of any name, are ignored.  A record is limited to the 128 MiB
of the engine's variants.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.storage import saved

# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Turn:
    """One turn: a fixed role, or the path of one; texts of several paths are joined, empty ones left out.
    An ``optional`` turn without text is no turn."""

    texts: tuple[str, ...]
    role: str = ""
    role_path: str = ""
    optional: bool = False


@dataclass(frozen=True)
class Each:
    """A turn for every element of a list: objects with a text and a role, or, with ``roles``, texts that take turns."""

    items: str
    text: str = ""
    role: str = ""
    roles: tuple[str, ...] = ()


@dataclass(frozen=True)
class Layout:
    """``paths``: of all fields, ``[]`` behind a list. ``order``: path of the place of a record's turns in its conversation."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Turn | Each, ...]
    order: str = ""
    aliases: tuple[tuple[str, str], ...] = ()


# Names of roles in public layouts, and the layouts.
ALIASES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatgpt", "assistant"))
LAYOUTS = (
    Layout("turn row", ("role", "text", "turn"), (Turn(("text",), role_path="role"),), order="turn"),
    Layout("messages", ("messages[].content", "messages[].role"), (Each("messages", "content", "role"),), aliases=ALIASES),
    Layout("messages with system", ("messages[].content", "messages[].role", "system"), (Turn(("system",), "system", optional=True), Each("messages", "content", "role")), aliases=ALIASES),
    Layout("shared conversation", ("conversations[].from", "conversations[].value"), (Each("conversations", "value", "from"),), aliases=ALIASES),
    Layout("shared conversation with system", ("conversations[].from", "conversations[].value", "system"), (Turn(("system",), "system", optional=True), Each("conversations", "value", "from")), aliases=ALIASES),
    Layout("request and reply", ("request.messages[].content", "request.messages[].role", "response.content"), (Each("request.messages", "content", "role"), Turn(("response.content",), "assistant")), aliases=ALIASES),
    Layout("prompt and completion", ("completion", "prompt"), (Turn(("prompt",), "user"), Turn(("completion",), "assistant"))),
    Layout("prompt and response", ("prompt", "response"), (Turn(("prompt",), "user"), Turn(("response",), "assistant"))),
    Layout("question and answer", ("answer", "question"), (Turn(("question",), "user"), Turn(("answer",), "assistant"))),
    Layout("question with system", ("question", "response", "system_prompt"), (Turn(("system_prompt",), "system", optional=True), Turn(("question",), "user"), Turn(("response",), "assistant"))),
    Layout("instruction", ("instruction", "output"), (Turn(("instruction",), "user"), Turn(("output",), "assistant"))),
    Layout("instruction with input", ("input", "instruction", "output"), (Turn(("instruction", "input"), "user"), Turn(("output",), "assistant"))),
    Layout("instruction with context", ("category", "context", "instruction", "response"), (Turn(("instruction", "context"), "user"), Turn(("response",), "assistant"))),
    Layout("chosen and rejected", ("chosen", "prompt", "rejected"), (Turn(("prompt",), "user"), Turn(("chosen",), "assistant"))),
    Layout("dialog", ("dialog[]",), (Each("dialog", roles=("user", "assistant")),)),
)


def shape_of(paths: tuple[str, ...]) -> str:
    """The canonical form of nested field paths: names in order, ``*`` for any value that is neither object nor list."""
    if paths in ((), ("",)):
        return "*"
    if all(p.startswith("[]") for p in paths):
        return f"ARRAY<{shape_of(tuple(p[2:].removeprefix('.') for p in paths))}>"
    fields: dict[str, list[str]] = {}
    for p in paths:
        name = re.match(r"[A-Za-z_]\w*", p)
        if not name:
            raise ValueError(f"not a path of simple names: {p!r}")
        fields.setdefault(name[0], []).append(p[len(name[0]) :].removeprefix("."))
    return f"OBJECT<{', '.join(f'{k}: {shape_of(tuple(v))}' for k, v in sorted(fields.items()))}>"


def shapes_of(layout: Layout) -> list[str]:
    """Shapes of a layout: with its lists filled, and with each of them empty."""
    out = [layout.paths]
    for t in layout.turns:
        if isinstance(t, Each):
            out += [tuple(dict.fromkeys(f"{t.items}[]" if p.startswith(f"{t.items}[]") else p for p in paths)) for paths in out]
    return list(dict.fromkeys(map(shape_of, out)))


def as_variant(df: DataFrame, column: str) -> Column:
    """A record column as a variant: JSON text, structs or variants."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.try_parse_json(df[column])
    return df[column] if isinstance(kind, T.VariantType) else F.when(df[column].isNotNull(), F.to_variant_object(df[column]))


def record_shape(record: Column) -> Column:
    """The nested field paths of a variant in the form of ``shape_of``."""
    return F.regexp_replace(F.schema_of_variant(record), r"(^|: |<)[A-Z_]+(\([0-9, ]*\))?(?=[,>]|$)", r"$1*")


def fingerprint(shape: Column | str) -> Column:
    return F.substring(F.sha2(F.lit(shape) if isinstance(shape, str) else shape, 256), 1, 16)


def _role(value: Column, layout: Layout) -> Column:
    value = F.coalesce(value, F.lit(""))
    return reduce(lambda out, pair: F.when(F.lower(value) == pair[0], pair[1]).otherwise(out), layout.aliases, value)


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}" if path else "$", "string")


def _named(t: Each, layout: Layout) -> Callable[[Column], Column]:
    """The turn of an object of a list."""
    return lambda item: F.struct(_role(_get(item, t.role), layout).alias("role"), F.coalesce(_get(item, t.text), F.lit("")).alias("text"))


def _alternating(t: Each) -> Callable[[Column, Column], Column]:
    """The turn of a text of a list, by its place."""
    names = F.array(*map(F.lit, t.roles))
    return lambda item, i: F.struct(F.get(names, i % len(t.roles)).alias("role"), F.coalesce(_get(item, ""), F.lit("")).alias("text"))


def _turns(record: Column, layout: Layout) -> Column:
    """array<struct<role, text>> of a record of this layout."""
    out = []
    for t in layout.turns:
        if isinstance(t, Each):
            items = F.coalesce(F.try_variant_get(record, f"$.{t.items}", "array<variant>"), F.expr("cast(array() as array<variant>)"))
            one = _alternating(t) if t.roles else _named(t, layout)
            out.append(F.transform(items, one))
            continue
        texts = [F.coalesce(_get(record, p), F.lit("")) for p in t.texts]
        text = texts[0] if len(texts) == 1 else F.array_join(F.array_remove(F.array(*texts), ""), "\n\n")
        role = _role(_get(record, t.role_path), layout) if t.role_path else F.lit(t.role)
        one = F.array(F.struct(role.alias("role"), text.alias("text")))
        out.append(F.filter(one, lambda x: x["text"] != "") if t.optional else one)
    return F.concat(*out)


_TURNS = "array<struct<role:string,text:string>>"


def canonical(records: DataFrame, record: str = "record", key: str = "key", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, fingerprint, layout, ord, turns) of every record; without a mapping, layout is null and turns are empty."""
    rows = records.select(records[key].alias(key), as_variant(records, record).alias("record")).withColumn("fingerprint", fingerprint(F.coalesce(record_shape(F.col("record")), F.lit(""))))
    turns, name, order = F.expr(f"cast(array() as {_TURNS})"), F.lit(None).cast("string"), F.lit(0).cast("bigint")
    for layout in reversed(layouts):
        fits = reduce(lambda a, b: a | b, (F.col("fingerprint") == fingerprint(s) for s in shapes_of(layout)))
        turns, name = F.when(fits, _turns(F.col("record"), layout).cast(_TURNS)).otherwise(turns), F.when(fits, layout.name).otherwise(name)
        if layout.order:
            order = F.when(fits, F.try_variant_get("record", f"$.{layout.order}", "bigint")).otherwise(order)
    return rows.select(key, "fingerprint", name.alias("layout"), order.alias("ord"), turns.alias("turns"))


def layouts_of(records: DataFrame, record: str = "record") -> DataFrame:
    """(shape, fingerprint, layout, n): what layouts a table holds, those without a mapping included."""
    known = F.create_map(*(F.lit(x) for layout in LAYOUTS for s in shapes_of(layout) for x in (s, layout.name)))
    shape = F.coalesce(record_shape(as_variant(records, record)), F.lit(""))
    return records.select(shape.alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n")).select("shape", fingerprint(F.col("shape")).alias("fingerprint"), F.try_element_at(known, F.col("shape")).alias("layout"), "n")


# ---------------------------------------------------------------- template


@dataclass(frozen=True)
class Template:
    r"""``start`` role newline text ``stop``. ``controls``: strings besides these two that must not stand in texts.
    Escapes: ``\\`` is one backslash, ``\~`` nothing, ``\n`` a line end in a role. ``trained``: roles under the loss mask."""

    start: str = "<turn>"
    stop: str = "</turn>\n"
    # Control strings of public chat formats and tokenizers.
    controls: tuple[str, ...] = ("### System:", "### User:", "### Assistant:", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "[INST]", "[/INST]", "<s>", "</s>")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for c in self.marks():
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"a control string has two characters at least and no backslash: {c!r}")
        for c in (self.start, self.stop):
            if any(c.startswith(c[i:]) for i in range(1, len(c))):
                raise ValueError(f"a mark must not end with its own beginning: {c!r}")

    def marks(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c.strip() for c in (self.start, self.stop, *self.controls)))

    def escaped(self, text: Column) -> Column:
        """No control string stands in the result: behind the first character of each, overlapping ones too, stands a break."""
        first = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.marks())
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?:{first})", r"$0\\~")

    def header(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), F.replace(self.escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


_ESCAPES = {"\\\\": "\\", "\\~": "", "\\n": "\n"}


def unescaped(text: str) -> str:
    return re.sub(r"\\[\\~n]", lambda m: _ESCAPES[m[0]], text) if "\\" in text else text


def parsed(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of every turn of formatted text; raises if anything else stands in it."""
    out, at = [], 0
    for m in re.finditer(f"{re.escape(template.start)}([^\n]*)\n(.*?){re.escape(template.stop)}", formatted, re.S):
        if m.start() != at:
            break
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


# ---------------------------------------------------------------- output

_MASK = "array<struct<start:bigint,stop:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def formatted(turns: DataFrame, key: str = "key", template: Template = Template(), fragment_chars: int = 1 << 20) -> DataFrame:
    """(key, task, part, formatted, mask, n_turns) from (key, ord, turns): every conversation in fragments of some
    ``fragment_chars``, or one longer turn, ordered by (task, part); ``mask`` has spans of code points of the fragment."""
    rows = turns.select(turns[key].alias("key"), "ord", F.posexplode("turns").alias("place", "t")).select("key", "ord", "place", "t.role", "t.text")
    dealt = rows.repartitionByRange("key", "ord", "place", "role", F.substring("text", 1, 64)).sortWithinPartitions("key", "ord", "place", "role", "text")
    head, body = template.header(F.col("role")), template.escaped(F.col("text"))
    pieces = dealt.select("key", head.alias("head"), body.alias("body"), F.col("role").isin(*template.trained).alias("trained"))
    names = [key, "task", "part", "formatted", "mask", "n_turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, now, held, size, mask, n, kind = TaskContext.get().partitionId(), 0, None, [], 0, [], 0, None

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([now], kind), pa.array([task], pa.int32()), pa.array([part], pa.int64()), pa.array(["".join(held)]), pa.array([mask], _SPAN), pa.array([n], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, h, b, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (k != now or size >= fragment_chars):
                    yield flushed()
                    part, held, size, mask, n = part + 1, [], 0, [], 0
                now = k
                if trained:
                    mask.append({"start": size + len(h), "stop": size + len(h) + len(b)})
                held += [h, b, template.stop]
                size += len(h) + len(b) + len(template.stop)
                n += 1
        if held:
            yield flushed()

    schema = T.StructType([T.StructField(key, turns.schema[key].dataType), *T.StructType.fromDDL(f"task int, part bigint, formatted string, mask {_MASK}, n_turns bigint")])
    return pieces.mapInArrow(run, schema)


def turns_of(fragments: DataFrame, key: str = "key", template: Template = Template()) -> DataFrame:
    """(key, task, part, place, role, text): the turns read back from fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                turns = parsed(text, template)
                same = [pa.concat_arrays([batch.column(c).slice(i, 1)] * len(turns)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(turns)), pa.int64()), pa.array([t[0] for t in turns], pa.string()), pa.array([t[1] for t in turns], pa.string())], names=[key, "task", "part", "place", "role", "text"])

    schema = T.StructType([T.StructField(key, fragments.schema[key].dataType), *T.StructType.fromDDL("task int, part bigint, place bigint, role string, text string")])
    return fragments.select(key, "task", "part", "formatted").mapInArrow(run, schema)


def digests(fragments: DataFrame, key: str = "key", template: Template = Template()) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation.

    A digest takes its text in order, so the fragments of one conversation pass
    through one task, one by one; nothing else of it is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, begun, kind = None, False, None
        n, loss, chars, all_turns, masked = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, text, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if begun and k != now:
                    out.append((now, n, all_turns.hexdigest(), loss, masked.hexdigest(), chars))
                    n, loss, chars, all_turns, masked = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                now, begun = k, True
                for role, own in parsed(text, template):
                    all_turns.update(f"{role}\n{own}\n".encode())
                    n += 1
                for span in mask:
                    own = unescaped(text[span["start"] : span["stop"]])
                    masked.update(own.encode())
                    loss += len(own)
                chars += len(text)
            yield _rows(out, kind, names)
        if begun:
            yield _rows([(now, n, all_turns.hexdigest(), loss, masked.hexdigest(), chars)], kind, names)

    dealt = fragments.repartition(F.col(key)).sortWithinPartitions(key, "task", "part").select(key, "formatted", "mask")
    schema = T.StructType([T.StructField(key, fragments.schema[key].dataType), *T.StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")])
    return dealt.mapInArrow(run, schema)


def _rows(out: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*out, strict=True) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


#: A conversation that tries the template: (conv_id, turn, role, text).
TRICKY = [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]


def digested(conversations: DataFrame) -> DataFrame:
    """Digests of rows (conv_id, turn, role, text), formatted, written and read back."""
    records = conversations.select("conv_id", F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("bigint").alias("turn")).alias("record"))
    fragments = saved(formatted(canonical(records, "record", "conv_id"), "conv_id"), "chat-fragments")
    return digests(fragments, "conv_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over the whole ``conversations`` table and one conversation more."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digested(rows.unionByName(spark.createDataFrame(TRICKY, "conv_id bigint, turn bigint, role string, text string")))


def _sql() -> str:
    template = Template()
    body = reduce(lambda out, c: f"replace({out}, '{c}', '{c[0]}\\~{c[1:]}')", template.marks(), "replace(text, '\\', '\\\\')")
    more = ", ".join(f"({conv}, {turn}, '{role}', '{text}')" for conv, turn, role, text in TRICKY)
    fixed = len(template.start) + 1 + len(template.stop)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {more}) AS more(conv_id, turn, role, text)))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({fixed} + length(role) + length({body}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


SQL = _sql()
