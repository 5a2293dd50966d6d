"""Personal data: expressions propose, checksums confirm, context scores.

Kinds: email, ip, card (Luhn), phone, then those of the method itself: iban
(mod 97), ssn and tel.  The last two have no checksum and count only with a
context word before them.  A span of the method never overlaps a base span.

Edge cases: a null or empty text has no spans; every text is scanned whole;
repeated rows are scanned one by one; an empty table gives an empty result;
other columns of the input are ignored.  Repetitions are possessive, so long
runs neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.exprs import char_at, clear_of, count_kind, joined, let, no_spans, spans_of, text_of

# Kind -> (expression, score, score with a context word).
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z_])"
SSN = r"(?<![0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_])"
TEL = r"(?<![0-9A-Za-z_])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z_])"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "host|server|address|login",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security",
    "tel": "phone|tel|call|mobile|fax",
}
SCORES = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 90, "ssn": 40, "tel": 40}
BONUS = 10
#: Code points before a span that are searched for context words.
WINDOW = 40


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for a digit string whose Luhn sum is a multiple of ten."""

    def total(d: Column) -> Column:
        def part(i: Column) -> Column:
            v = char_at(d, F.length(d) - i).cast("int")
            return F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, F.lit(9)).otherwise(F.lit(0)))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), part), F.lit(0), lambda a, x: a + x)

    return let(digits, total) % 10 == 0


def mod97(iban: Column) -> Column:
    """True for an account number whose remainder by 97 is one."""

    def rest(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            code = F.ascii(char_at(v, i))
            return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), step)

    packed = F.replace(iban, F.lit(" "), F.lit(""))
    return let(packed, lambda p: rest(F.concat(F.substr(p, F.lit(5)), F.substr(p, F.lit(1), F.lit(4))))) == 1


def in_context(text: Column, span: Column, kind: str) -> Column:
    before = F.substr(text, F.greatest(span["start"] - WINDOW, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(WINDOW)).cast("int"))
    return F.lower(before).rlike(CONTEXT[kind])


def base_spans(text: Column) -> Column:
    """The four base kinds in their order, each by start."""
    ok_card = lambda s: let(
        digits_of(s["value"]), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    )
    return F.concat(
        F.when(text.contains("@"), spans_of(text, EMAIL, "email")).otherwise(no_spans()),
        F.filter(spans_of(text, IP, "ip"), lambda s: s["value"].rlike(OCTETS)),
        F.filter(spans_of(text, CARD, "card"), ok_card),
        F.filter(spans_of(text, PHONE, "phone"), lambda s: F.length(digits_of(s["value"])).between(9, 15)),
    )


def more_spans(text: Column, base: Column) -> Column:
    """Spans that the method adds: iban, ssn, tel."""
    found = F.concat(
        F.filter(spans_of(text, IBAN, "iban"), lambda s: mod97(s["value"])),
        F.filter(spans_of(text, SSN, "ssn"), lambda s: in_context(text, s, "ssn")),
        F.filter(spans_of(text, TEL, "tel"), lambda s: in_context(text, s, "tel")),
    )
    return F.when(F.size(base) == 0, found).otherwise(F.filter(found, lambda s: clear_of(s, base)))


def score(text: Column, span: Column) -> Column:
    """0 to 100: the kind's score, raised by a context word."""
    value = F.lit(None).cast("int")
    for kind, points in SCORES.items():
        value = F.when(span["kind"] == kind, F.lit(points) + F.when(in_context(text, span, kind), BONUS).otherwise(0)).otherwise(value)
    return value


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base, found (all spans) and scores of every row: one narrow stage."""
    body = docs.select(docs[key].alias(key), text_of(docs, text).alias("__text"))
    body = body.select(
        key,
        "__text",
        let(base_spans(F.col("__text")), lambda b: F.struct(b.alias("base"), F.concat(b, more_spans(F.col("__text"), b)).alias("found"))).alias("s"),
    )
    return body.select(
        key,
        F.col("s.base").alias("base"),
        F.col("s.found").alias("found"),
        F.transform(F.col("s.found"), lambda s: score(F.col("__text"), s)).alias("scores"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4 over the whole ``documents`` table."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("scores", lambda s: s.cast("string")), ",").alias("scores"),
    )


def _sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PHONE,
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "tel": r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
    }
    raw = " UNION ALL ".join(
        f"SELECT doc_id, text, {i} AS k, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value,"
        f" unnest(string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS gap,"
        f" generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d"
        for i, (kind, p) in enumerate(patterns.items())
    )
    context = " ".join(f"WHEN '{k}' THEN regexp_matches(before, '{p}')" for k, p in CONTEXT.items())
    points = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({raw}),
placed AS (SELECT *, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop FROM raw),
v AS (SELECT doc_id, k, kind, value, stop - length(value) AS start, stop, regexp_replace(value, '[^0-9]', '', 'g') AS dg,
  lower(substr(text, greatest(stop - length(value) - {WINDOW}, 0) + 1, least(stop - length(value), {WINDOW}))) AS before FROM placed),
c AS (SELECT *, CASE kind {context} END AS ctx,
  CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_matches(value, '{OCTETS}')
    WHEN 'card' THEN length(dg) BETWEEN 13 AND 19 AND list_sum([CASE WHEN j % 2 = 0 THEN CAST(dg[length(dg) - j] AS INT)
      ELSE CAST(dg[length(dg) - j] AS INT) * 2 - CASE WHEN CAST(dg[length(dg) - j] AS INT) > 4 THEN 9 ELSE 0 END END for j in range(0, CAST(length(dg) AS BIGINT))]) % 10 = 0
    WHEN 'phone' THEN length(dg) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce(list_prepend(0, [CASE WHEN ascii(x) < 65 THEN ascii(x) - 48 ELSE ascii(x) - 55 END
      for x in string_split(substr(replace(value, ' ', ''), 5) || substr(replace(value, ' ', ''), 1, 4), '')]),
      lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
    ELSE true END AS good FROM v),
ok AS (SELECT * FROM c WHERE good AND (k < 5 OR ctx)),
keep AS (SELECT * FROM ok o WHERE k < 4 OR NOT EXISTS (SELECT 1 FROM ok b WHERE b.doc_id = o.doc_id AND b.k < 4 AND b.start < o.stop AND o.start < b.stop)),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (k < 4) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans,
  string_agg(CAST(CASE kind {points} END + CASE WHEN ctx THEN {BONUS} ELSE 0 END AS VARCHAR), ',' ORDER BY k, start) AS scores
  FROM keep GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN agg USING (doc_id)
"""


SQL = _sql()
