"""Token counts of long texts without a splice in bounded time, and shard maps that are edited from run to run."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF
from rareflow.llm import sharding, token_counts
from rareflow.session import work_path

SP = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(SP)


@pytest.mark.parametrize("letters", ["e", "etao", "é日"])
def test_four_million_letters_in_bounded_time(counter, letters):
    r = random.Random(1)
    text = "".join(r.choices(letters, k=4 << 20))
    begin = time.monotonic()
    want = len(counter.model.encode(text))
    whole = time.monotonic() - begin
    begin = time.monotonic()
    assert counter.count(text) == want
    assert time.monotonic() - begin < 12 * whole + 20


def test_marks_are_spaces_and_chunks_are_spliced(counter):
    small = token_counts.PieceCounter(SP, 64, 8)
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(["▁", "a", "th", " ", "e▁", "é", "\n", "日本", "tion", "  ▁"]) for _ in range(r.randint(0, 300)))
        assert small.count(text) == len(small.model.encode(text)), text


def test_counts_of_the_table_are_the_models(spark, counter):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, SP, chunk=512, overlap=16).collect()}
    assert got == {r.doc_id: len(counter.model.encode(r.text or "")) for r in docs.collect()}


def test_a_stored_map_is_edited_by_later_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = work_path(spark, "t-shards")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + sharding.RECORD_BYTES)).first()[0]

    def run(rows, shards):
        out = {r.doc_id: r for r in sharding.shard(rows, shards, slots=512, folder=folder).collect()}
        assert {r.shard for r in out.values()} <= set(range(shards))
        return out

    def moved(a, b):
        return sum(b[i].size for i in a if i in b and a[i].shard != b[i].shard) / total

    first, again = run(docs, 8), run(docs, 8)
    assert {r.version for r in first.values()} == {2} and {r.version for r in again.values()} == {3}
    assert moved(first, again) < 0.02
    grown = run(docs, 9)
    assert {r.version for r in grown.values()} == {4} and {r.shard for r in grown.values()} == set(range(9)) and moved(again, grown) < 0.25
    shrunk = run(docs, 7)
    assert {r.shard for r in shrunk.values()} == set(range(7)) and moved(grown, shrunk) < 0.4
    maps = {v: {r.v_slot: r.shard for r in sharding.load_map(spark, f"{folder}/map", v).collect()} for v in range(1, 6)}
    assert all(len(m) == 512 for m in maps.values())
    load = {}
    for r in shrunk.values():
        load[r.shard] = load.get(r.shard, 0) + r.size
    largest = max(r.size for r in shrunk.values())
    assert max(load.values()) - min(load.values()) <= 2 * largest + total / 100
