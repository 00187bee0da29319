"""The byte-level BPE against the tiktoken library, its offsets and decoding; equal hashes are never taken for equal words."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from conftest import SF
from llm_fixtures import empty, odd  # noqa: F401
from rareflow.llm import byte_bpe, ngram_join, queries, shingles, tokens

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(RANKS, PATTERN)


ALPHABETS = ["a", "ab", " \n", "-=", "the ", "ab \n", "é b", "\xa0x ", "x　y  \n", "  a", "<|endoftext|> ", " \t\n\x0b", "a's 'll \n", "0123 ", "中文a", "😀é "]


def words(seed, many, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randint(0, longest))) for _ in range(many)]


def test_ids_are_those_of_tiktoken(bpe, plain, monkeypatch):
    texts = words(1, 4000)
    want = [plain.encode_ordinary(t) for t in texts]
    assert [i.tolist() for i in bpe.encode([t.encode() for t in texts])] == want
    monkeypatch.setattr(tokens.blocks, "__defaults__", (50,))  # cut inside texts
    assert [i.tolist() for i in bpe.encode([t.encode() for t in texts])] == want


def test_decoding_and_offsets(bpe):
    for text in words(2, 500):
        ids = bpe.encode([text.encode()])[0]
        assert bpe.decode(ids) == text.encode() and bpe.decode_text([ids]) == text
        assert bpe.decode_text([ids[i:i + 1] for i in range(len(ids))]) == text  # characters split over portions
        assert list(zip(*(x.tolist() for x in bpe.offsets(ids)), strict=True)) == bpe.units.tokenizer.encode(text, add_special_tokens=False).offsets
    assert bpe.decode_text([bpe.encode(["日".encode()])[0][:1]]) == "�"


def test_tables(spark, odd, empty, plain):
    want = Counter((r.doc_id, tuple(plain.encode_ordinary(r.text or ""))) for r in odd.collect())
    encoded = byte_bpe.encode(odd, RANKS, PATTERN)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    assert Counter(map(tuple, byte_bpe.decode(encoded, RANKS, PATTERN).collect())) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    digests = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trips(odd, RANKS, PATTERN).collect())
    assert digests == Counter((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
                              for r in odd.collect() for ids in [plain.encode_ordinary(r.text or "")])
    for f in (byte_bpe.encode, byte_bpe.round_trips):
        assert f(empty, RANKS, PATTERN).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>"), RANKS, PATTERN).collect() == [(1, ""), (None, "")]


def test_query_on_documents(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = plain.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_very_long_texts(bpe):
    for text in (b"x" * (4 << 20), b"ab cd" * (4 << 20)):
        ids = bpe.encode([text])[0]
        assert bpe.decode(ids) == text


def complements(length):
    """A Thue-Morse word and its complement: equal under every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [1024, 2048, 4096])
@pytest.mark.parametrize("turn", [1, -1])
def test_crafted_words_are_told_apart(spark, length, turn):
    pair = complements(length)[::turn]
    encode = tokens.UnitEncoder(JSON)
    for text in (*pair, *("x " + w + " y" for w in pair)):
        assert encode.encode([text.encode()])[0].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(i, w + " one two three four") for i, w in enumerate(pair)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.similar_groups(docs).collect()} == {0, 1}


def test_near_words_have_their_own_fingerprints():
    r = random.Random(4)
    base = "".join(r.choice("ab") for _ in range(40))
    near = {base[:n] + "".join(r.choice("ab\0") for _ in range(k)) for n in range(40) for k in range(1, 40) for _ in range(8)} | {"a" * n for n in range(1, 300)}
    near = sorted(near)
    _, _, prints = shingles.word_prints(" ".join(near).encode())
    assert len(set(prints.tolist())) == len(near)


def test_units_with_one_hash_are_encoded_whole(monkeypatch):
    monkeypatch.setattr(tokens, "fold_keys", lambda high, low: np.zeros(len(high), np.uint64))
    encode = tokens.UnitEncoder(JSON)
    for text in ("one two three", "four five", "one"):
        assert encode.encode([text.encode()])[0].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_shingles_of_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"W{i}" for i in range(3000)).encode()
    whole = shingles.shingle_sets([text])[0]
    monkeypatch.setattr(shingles, "BLOCK", 100)
    monkeypatch.setattr(shingles.segments, "__defaults__", (100,))
    assert len(whole) == 2996 and shingles.shingle_sets([text])[0].tolist() == whole.tolist()
    assert shingles.shingle_sets([b"x" * 500])[0].tolist() == shingles._long(b"X" * 500, 5).tolist()
