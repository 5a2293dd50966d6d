"""Words that polynomial hashes modulo a power of two cannot tell apart."""

import public_tokenizers

from pathloom.llm import jaccard, pieces, tokenfiles
from pathloom.llm import textkernel as kernel


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


ONE, TWO = thue_morse(10)


def test_numbers_of_words_go_by_their_bytes(monkeypatch):
    monkeypatch.setattr(kernel, "segment_hashes", lambda raw, loads, starts, stops: (stops - starts).astype("u8") % 3)
    words, seen = kernel.Words(), {}
    for text in (b"aa bb cc aa dddd", f"{ONE} {TWO} aa eeee {ONE}".encode(), f"dddd {TWO} bb f".encode()):
        _, raw, starts, stops = kernel.split_words([text])
        numbers, fresh = words.numbers(raw, starts, stops)
        assert len(numbers) == len(text.split()) and len(words) == len(set(seen.values()) | set(numbers.tolist()))
        assert all(seen.setdefault(w, n) == n for w, n in zip(text.split(), numbers.tolist()))
    assert len(set(seen.values())) == len(seen)


def test_ids_of_both_words(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [f"{ONE} {TWO}", f"{TWO} {ONE} {TWO}", TWO]
    bpe = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(bpe)
    got = tokenfiles.Encoder(bpe, 1000).encode(texts, 1)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), model).collect()
    piece = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: piece.encode(t) for i, t in enumerate(texts)}


def test_sets_of_both_words(spark):
    docs = spark.createDataFrame([(1, " ".join([ONE] * 9)), (2, " ".join([TWO] * 9)), (3, " ".join([ONE] * 12)), (None, TWO)], "doc_id bigint, text string").coalesce(1)
    rows = jaccard.link_classes(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["set_id"]) for r in rows} == {(1, 1, 1, 1), (2, 1, 2, 2), (3, 1, 1, 1), (None, 1, None, None)}
