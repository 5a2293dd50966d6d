"""Nulls, blanks, long runs, repeats, empty tables and clashing names for every operator, against brute force."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from pathloom.llm import decontaminate, jaccard, licenses, pieces, pii, quality, secrets, tokencount, tokenfiles, urls
from pathloom.llm.storage import new_path
from tests.llm.conftest import EDGE_TEXTS

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_quality(spark, edge_docs, empty_docs):
    got = by_id(quality.line_first(edge_docs))
    for i, text in enumerate(EDGE_TEXTS):
        words = WORD.findall(text or "")
        grams = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        repeat = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 100 else None
        assert got[i]["n_words"] == len(words) and got[i]["word_chars"] == sum(map(len, words))
        assert repeat is None or got[i]["n_repeat_words"] == len(repeat)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert got[i]["n_dup_lines"] == len(lines) - len(set(lines))
    assert quality.line_first(edge_docs).count() == edge_docs.count() and quality.line_first(empty_docs).count() == 0
    assert {r["doc_id"] for r in edge_docs.where(quality.keeps(edge_docs["text"])).collect()} == {k for k, r in got.items() if r["kept"]}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii(spark, edge_docs, empty_docs):
    got = by_id(pii.find_pii(edge_docs))
    assert pii.find_pii(empty_docs).count() == 0
    for i, text in enumerate(EDGE_TEXTS):
        text, want = text or "", []
        want += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
        want += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [(s["kind"], s["start"], s["stop"]) for s in got[i]["base"]] == want
    more = {s["kind"] for r in got.values() for s in r["found"]} - {"email", "ip", "card", "phone"}
    assert more == {"iban", "tel"}


def test_secrets(spark, edge_docs, empty_docs):
    model = secrets.default_model(edge_docs)
    assert secrets.find_secrets(empty_docs, secrets.default_model(empty_docs)).count() == 0
    got = by_id(secrets.find_secrets(edge_docs, model))
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text in enumerate(EDGE_TEXTS):
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
        names = ["assign", "access", "hex"]
        assert [(s["start"], names.index(s["kind"]), s["stop"]) for s in got[i]["base"]] == sorted(want)


def test_secret_models_tell_held_out_samples_apart(spark, edge_docs):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.default_model(docs)
    digests = spark.range(50_000, 50_300).select(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))).cast("string").alias("v"))
    names = spark.createDataFrame([(f"{a}_{b}_value_{a}",) for a in ("user", "config", "request", "parser") for b in ("name", "count", "handler", "index")], "v string")
    assert digests.where(secrets.ratio(F.col("v"), model) > 9000).count() == 300
    assert names.where(secrets.ratio(F.col("v"), model) > 0).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/1?x#y"), (4, "x://www.example.com/en/2"), (5, "http://net/fr/"), (6, "http://net"), (6, "http://b.net/de/1"), (None, "http://c.com/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(3, 1), (None, 1)], "id bigint, bad int")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, labels).collect())
    assert [g[:4] for g in got] == [
        (0, "c.com", "/", "com/"), (1, "", "", None), (2, "", "", None), (3, "a.example.com", "/en/1", "example.com/en/"),
        (4, "www.example.com", "/en/2", "www.example.com/en/"), (5, "net", "/fr/", "net/fr/"), (6, "b.net", "/de/1", None), (6, "net", "", None),
    ]
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_urls_reject_a_bad_template(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "id bigint, bad int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(400)}


def test_token_counts_and_files(spark, edge_docs, empty_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    counts = by_id(tokencount.token_counts(edge_docs, BPE))
    folder = new_path(spark, "test-files")
    manifest = tokenfiles.write(edge_docs, BPE, folder)
    files = tokenfiles.read(manifest, folder).collect()
    start = 0
    assert len(files) == edge_docs.count()
    for r in sorted(files, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    by = {r["doc_id"]: r for r in files}
    for i, text in enumerate(EDGE_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert counts[i]["n_tokens"] == len(ids) and counts[i]["n_bytes"] == len((text or "").encode())
        assert by[i]["ids_crc32"] == zlib.crc32(np.array([*ids, 1], "<u4").tobytes())
    path = manifest.orderBy("shard").collect()[-1]["path"]
    shard = tokenfiles.Shard(path, tokenfiles._dictionary(folder, path))
    key = int(shard.keys[-1])
    assert shard.find(key)[-1] == 1 and shard.find(10**9) is None
    assert tokencount.token_counts(empty_docs, BPE).count() == 0
    empty = new_path(spark, "test-files")
    assert tokenfiles.read(tokenfiles.write(empty_docs, BPE, empty), empty).count() == 0


def test_a_shard_needs_its_dictionary(tmp_path):
    told = {}
    tokenfiles.write_bytes(f"{tmp_path}/a", tokenfiles.shard_bytes(iter([(5, np.array([1, 2], np.uint32))]), b"", 2, 3, told))
    assert tokenfiles.Shard(f"{tmp_path}/a", b"").find(5).tolist() == [1, 2] and told["n_tokens"] == 2
    with pytest.raises(ValueError):
        tokenfiles.Shard(f"{tmp_path}/a", b"other")


def test_merges_equal_one_by_one_merging():
    merges = tokencount.Merges(BPE)
    words = [b"aaaaaaa", b"hello", b"x", b"\xc3\xa9t\xc3\xa9", b"zzzzzzzzzzz", b"anananan"]
    def slow(word):
        sym = merges.symbols([word])[0].tolist()
        while len(sym) > 1:
            ranks = merges.rank_of(np.array(sym[:-1]), np.array(sym[1:]))
            if ranks.min() == tokencount.NONE:
                break
            i = int(ranks.argmin())
            sym[i : i + 2] = [int(merges.merged[ranks[i]])]
        return len(sym)
    assert merges.merge(words).tolist() == [slow(w) for w in words]


def test_licenses(spark, edge_docs, empty_docs):
    got = by_id(licenses.scan_licenses(edge_docs))
    assert licenses.scan_licenses(empty_docs).count() == 0
    for i, text in enumerate(EDGE_TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert got[i]["first_word"] == min((j for j, _ in places), default=None)


def test_license_matching_statistics_against_brute_force():
    import random

    rng = random.Random(5)
    automaton = licenses.Automaton([[0, 1, 2, 1, 0], [1, 2, 3], [0, 1, 2, 3, 0, 1]])
    seqs = [[0, 1, 2, 1, 0], [1, 2, 3], [0, 1, 2, 3, 0, 1]]
    inside = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        q = [rng.randrange(5) for _ in range(12)]
        for i, (_, n) in enumerate(automaton.statistics(q)):
            assert n == max(k for k in range(i + 2) if k == 0 or tuple(q[i + 1 - k : i + 1]) in inside)


def test_pieces(spark, edge_docs, empty_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode(edge_docs, PIECES)
    got = by_id(rows)
    for i, text in enumerate(EDGE_TEXTS):
        assert got[i]["ids"] == library.encode(text or "")
        assert got[i]["round_trip"]
    texts = by_id(pieces.decode(rows.select("doc_id", "ids"), PIECES))
    assert all(texts[i]["text"] == (t or "") for i, t in enumerate(EDGE_TEXTS))
    assert pieces.encode(empty_docs, PIECES).count() == 0


def test_leaks(spark, edge_docs, empty_docs):
    item = " ".join(f"word{i}" for i in range(30))
    changed = item.replace("word4 ", "other ").replace("word11 ", "other ").replace("word20 ", "other ")
    docs = spark.createDataFrame([(1, f"x y {changed} z"), (2, "clean " * 40), (3, None), (4, "short item here now"), (5, " ".join(item.split()[:9])), (6, f"\u00c9t\u00c9 STRASSE! {item.upper()}")], "doc_id bigint, text string")
    tests = spark.createDataFrame([(7, item), (8, None), (9, "Short item, here"), (10, ""), (11, "\u00e9t\u00e9 stra\u00dfe")], "item_id bigint, text string")
    for words in (500_000, 10):
        found = decontaminate.find_leaks(docs, tests, decontaminate.Settings(block_words=words))
        assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in found.collect()} == {1: [7], 2: [], 3: [], 4: [9], 5: [], 6: [7, 11]}
    assert decontaminate.find_leaks(edge_docs, tests.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.find_leaks(empty_docs, tests).count() == 0


def test_jaccard_against_all_pairs(spark, empty_docs):
    import random

    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    texts = [None, "", "one two", "ONE two", "one  two\n"]
    for b in base:
        for _ in range(12):
            words = list(b)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "one two", "x")], "doc_id bigint, text string, n string")
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(docs).collect()}
    assert got == {(i, len(sets[i]), root[i]) for i in sets}
    assert jaccard.link_classes(empty_docs).count() == 0
