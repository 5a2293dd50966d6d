"""Registered queries of the secret and license scans against plain expressions, over whole tables and on made texts."""

import hashlib
import random
import re
import string
import sys

import pytest

from pathloom.llm import licenses, secrets

SF = "/root/testdata/sf0.01"
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def plain_ratio(value, model):
    total, a = 0, secrets.START
    for c in value:
        b = secrets.ALPHABET.index(c)
        total, a = total + model.llr[a * len(secrets.ALPHABET) + b], b
    return total


def random_pieces(text, base, model, s):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % s.min_run, text):
        at = m.start()
        for start, _, stop in [*(b for b in base if b[0] < m.end() and m.start() < b[2]), (m.end(), 3, m.end())]:
            piece = text[at:start]
            if len(piece) >= s.min_run and (x := plain_ratio(piece, model)) >= s.min_llr and x >= len(piece) * s.per_char:
                out.append((at, 3, start))
            at = max(at, stop)
    return out


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def with_planted(spark, folder, texts):
    """A folder whose documents are those of the small table and ``texts`` under ids from 10**6 on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs.unionByName(more).write.parquet(f"{folder}/documents.parquet")
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_secret_query_against_plain_expressions(spark, tmp_path):
    rng = random.Random(8)
    noise = lambda n, of=string.ascii_letters + string.digits: "".join(rng.choice(of) for _ in range(n))
    planted = [None, "", f"key {noise(44)} end", f'PassWord: "{noise(12)}" api_key={noise(7)} API_KEY = {noise(8)}', f"AKIA{noise(12, string.ascii_uppercase)} AKIA{noise(11, string.ascii_uppercase)}"]
    planted += [f"{noise(31, '0123456789abcdef')}\n{noise(32, '0123456789abcdef')}", f"日本 {noise(40)} 🎉 secret={noise(20)}", f"x {noise(64)} " * 300]
    texts = with_planted(spark, tmp_path, planted)
    model, s = secrets.default_model(spark.read.parquet(f"{tmp_path}/documents.parquet")), secrets.Settings()
    rows = {r["doc_id"]: r for r in secrets.query(spark, str(tmp_path)).collect()}
    assert rows.keys() == texts.keys()
    for k, text in texts.items():
        base = base_secrets(text)
        more = random_pieces(text, base, model, s)
        r = rows[k]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["n_random"]) == (*(sum(b[1] == i for b in base) for i in range(3)), len(more))
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert r["spans"] == written(sorted(base + more))
    assert rows[10**6 + 2]["n_random"] == 1 and rows[10**6 + 7]["n_random"] == 300


@pytest.fixture(scope="module")
def model(spark):
    return secrets.default_model(spark.read.parquet(f"{SF}/documents.parquet"))


def reported(value, model, s=secrets.Settings()):
    return len(value) >= s.min_run and (x := plain_ratio(value, model)) >= s.min_llr and x >= len(value) * s.per_char


@pytest.mark.parametrize("of", [string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits])
@pytest.mark.parametrize("n", [20, 24, 32, 48])
def test_recall_by_length_and_alphabet(model, of, n):
    """Random strings, none of them a training sample."""
    rng = random.Random(4)
    found = sum(reported("".join(rng.choice(of) for _ in range(n)), model) for _ in range(1000))
    print(f"length {n}, {len(of)} characters: {found / 1000:.3f}")
    assert found / 1000 >= 0.99


def test_false_alarms_on_names_of_libraries(model):
    """Module and attribute names joined by underscores, as long runs; none is a training sample."""
    mine = ("asyncio", "email", "http", "json", "logging", "pyspark", "unittest", "urllib", "xml")
    modules = [(m, module) for m, module in list(sys.modules.items()) if module and m.split(".")[0] in mine]
    names = {f"{m.replace('.', '_')}_{a}" for m, module in modules for a in dir(module)}
    long = sorted(n for n in names if len(n) >= secrets.Settings().min_run and n.isascii())
    alarms = [n for n in long if reported(n, model)]
    print(f"{len(alarms)} of {len(long)}", alarms)
    assert len(long) > 1000 and len(alarms) <= len(long) / 100


def test_license_query_against_plain_phrases(spark, tmp_path):
    label, template = max(licenses.TEMPLATES, key=lambda t: len(t[1]))
    planted = [None, "", "Under-the_MIT license", "under the mit license under the MIT License", "UNDER THE MIT license, Version 2; Apache License, Version 2.0 cc-by-nc", "under thé mit license", "cc by nc " * 20_000, f"a {template} b {template}"]
    texts = with_planted(spark, tmp_path, planted)
    rows = {r["doc_id"]: r for r in licenses.query(spark, str(tmp_path)).collect()}
    assert rows.keys() == texts.keys()
    for k, text in texts.items():
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        joined = " " + " ".join(words) + " "
        places = sorted((joined.count(" ", 0, m.start()), name) for phrase, name in PHRASES.items() for m in re.finditer(f"(?= {phrase} )", joined))
        r, names = rows[k], {name for _, name in places}
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(names))
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and names <= set(labels) and 0 <= r["score"] <= 1
    assert label in rows[10**6 + 7]["labels"].split(",") and rows[10**6 + 6]["n_base"] == 20_000
