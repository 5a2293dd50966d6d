"""Registered queries of the tokenizers' operators against the libraries, over whole tables."""

import zlib

import numpy as np
import public_tokenizers

from pathloom.llm import licenses, pieces, secrets, tokencount, tokenfiles
from tests.llm.conftest import EDGE_TEXTS

SF = "/root/testdata/sf0.01"


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts_and_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_of(spark)
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    counts = {r["doc_id"]: r for r in tokencount.query(spark, SF).collect()}
    assert {k: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for k, r in counts.items()} == {k: (len(texts[k].encode()), len(v), len(v) > 2048) for k, v in ids.items()}
    start = 0
    files = {r["doc_id"]: r for r in tokenfiles.query(spark, SF).collect()}
    assert len(files) == len(texts)
    for k in sorted(texts):
        r, want = files[k], np.array([*ids[k], 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_repeated_ids_send_one_text_each_to_the_dictionary(spark):
    from pathloom.llm.storage import new_path

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    folder = new_path(spark, "test-files")
    rows = tokenfiles.read(tokenfiles.write(docs, public_tokenizers.path("word_bpe_49k.json"), folder, tokenfiles.Settings(shard_chars=1000)), folder).collect()
    assert len(rows) == 500 and len({r["start"] for r in rows}) == 500


def test_sentencepiece_ids(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = texts_of(spark)
    rows = pieces.query(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: library.encode(t) for k, t in texts.items()} and all(r["round_trip"] for r in rows)


def test_long_units_and_small_chunks(spark):
    """Units of any length go through the lattice; windows, chunks and texts of several chunks change nothing."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["-" * 300 + " =" * 40, "=" * 700, "x" * 5000, "the" * 100 + "ing" * 77, "http://www.example.com/" + "abcdefgh/" * 40, "a" * 62, "a" * 63, "  a  ", " ", "\n \n", "▁x", "x \U0001f600́ y", *[t or "" for t in EDGE_TEXTS]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for settings in (pieces.Settings(), pieces.Settings(chunk_chars=50, window=5, task_units=10)):
        got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, path, settings).collect()}
        assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_chunk_numbers_come_back():
    rng = np.random.default_rng(5)
    numbers = np.concatenate([rng.integers(0, n, 1000) for n in (100, 20_000, 900_000, 4_000_000_000)]).astype(np.uint32)
    assert (pieces._numbers(pieces._streams(numbers)) == numbers).all() and len(pieces._numbers(pieces._streams(numbers[:0]))) == 0


def ratio(value, model):
    n, a, total = len(secrets.ALPHABET), secrets.START, 0
    for c in value:
        b = secrets.ALPHABET.index(c)
        total += model.llr[a * n + b]
        a = b
    return total


def test_random_spans_of_texts_against_a_plain_scorer(spark):
    import random
    import re

    s = secrets.Settings()
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    texts = [f"see {noise(40)} and get_user_name_from_request_handler, {noise(24)}", f"AKIA{'Q' * 16}={noise(40)}", "password = " + noise(30), f"{noise(19)} {noise(20)} config/value_name-index_of_list", *[t or "" for t in EDGE_TEXTS]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = secrets.default_model(spark.read.parquet(f"{SF}/documents.parquet"))
    found = 0
    for r in secrets.find_secrets(docs, model).collect():
        text, base = texts[r["doc_id"]], [(b["start"], b["stop"]) for b in r["base"]]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            at, cuts = m.start(), sorted(b for b in base if b[0] < m.end() and m.start() < b[1])
            for start, stop in [*cuts, (m.end(), m.end())]:
                piece = text[at:start] if start > at else ""
                if len(piece) >= s.min_run and (x := ratio(piece, model)) >= s.min_llr and x >= len(piece) * s.per_char:
                    want.append((at, start))
                at = max(at, stop)
        assert sorted((x["start"], x["stop"]) for x in r["found"] if x["kind"] == "random") == want
        found += len(want)
    assert found >= 4


def test_license_spans_of_whole_and_damaged_texts(spark):
    """Every template is found whole, with some words left out, and not when it is shuffled."""
    import random

    rng = random.Random(3)
    scanner = licenses.Scanner()
    rows, want = [], {}
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        rows.append((3 * i, f"lorem ipsum {text} dolor sit"))
        want[3 * i] = label
        if len(words) > 25:
            rows.append((3 * i + 1, " ".join(w for j, w in enumerate(words) if j % 15 != 7)))
            want[3 * i + 1] = label
            rng.shuffle(words)
            rows.append((3 * i + 2, " ".join(words)))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), scanner).collect()}
    for i, _ in rows:
        found = set(got[i]["labels"].split(",")) if got[i]["labels"] else set()
        assert 0 <= got[i]["score"] <= 1
        if i in want:
            assert want[i] in found and got[i]["score"] >= scanner.settings.cover
        else:
            assert not got[i]["spans"]
