"""Stages of the pipeline against brute-force versions, and on odd inputs."""

import re

import public_tokenizers
import pytest

import corpus_pipeline
from pathloom.llm import quality
from tests.llm.conftest import EDGE_TEXTS
from tests.llm.test_leak_join import brute as leak
from tests.llm.test_leak_join import words_of

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def keeps(text):
    """The base rules in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    repeated = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    return not (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_quality_rules_reject_what_the_base_rules_fail(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in STAGES["quality_rules"](spark, docs, SF).collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality.query(spark, SF).collect()}
    assert kept == {k for k, v in verdict.items() if v}
    assert kept <= {r["doc_id"] for r in docs.collect() if keeps(r["text"])}


def test_decontamination_against_plain_words(spark):
    from pathloom.llm import decontaminate

    s = decontaminate.Settings()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r["doc_id"] for r in docs.collect() if not any(leak(words_of(r["text"]), i, s) for i in items if i))
    assert sorted(r["doc_id"] for r in STAGES["decontamination"](spark, docs, SF).collect()) == want


def test_near_copies_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = sorted(r["doc_id"] for r in STAGES["ngram_jaccard_join"](spark, docs, SF).collect())
    assert kept == [i for i in ids if find(i) == i]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_inputs(spark, name):
    """Nulls, blanks, repeats, long texts and clashing columns; and nothing at all."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [(i, t, None, "s", None, "x", 1) for i, t in enumerate(EDGE_TEXTS)] + [(1, "", None, None, 0, None, None), (None, "no id", "en", "s", 5, "x", 2), (None, None, None, None, None, None, None), (900, long, "en", "s", len(long), "y", 3), (900, long, "en", "s", len(long), "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, leaks string, component_id int")
    for table in (docs, docs.limit(0)):
        out = STAGES[name](spark, table, SF)
        got = out.collect()
        if name == "sentencepiece":
            assert len(got) == table.count() and all(r["round_trip"] for r in got)
            continue
        assert out.columns == docs.columns and {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}
        if name in ("decontamination", "secret_scans"):
            assert len(got) == table.count()
        if name == "secret_scans":
            assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_secrets_are_gone_and_the_rest_is_left(spark):
    from pathloom.llm import secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = {r["doc_id"]: sorted((s["start"], s["stop"]) for s in r["found"]) for r in secrets.find_secrets(docs, secrets.default_model(docs)).collect()}
    for r in STAGES["secret_scans"](spark, docs, SF).collect():
        out, at = "", 0
        for start, stop in found[r["doc_id"]]:
            if start >= at:
                out += before[r["doc_id"]][at:start] + "[secret]"
            at = max(at, stop)
        assert r["text"] == out + before[r["doc_id"]][at:]


def test_ids_are_the_library_s(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in STAGES["sentencepiece"](spark, docs, SF).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
