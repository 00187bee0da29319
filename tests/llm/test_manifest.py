"""The manifest against trees built plainly: digests, proofs, tampering, several rounds of segments, odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF
from llm_fixtures import empty, odd  # noqa: F401
from rareflow.llm import manifest, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, **changed):
    values = [changed.get(c, row[c]) for c in COLUMNS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, width=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + width])) for i in range(0, len(out[-1]), width)])
    return out


def siblings(tree, place, width=3):
    out = []
    for level in tree[:-1]:
        first = place // width * width
        out.append((level[first:place], level[place + 1:first + width]))
        place //= width
    return out


def plain(rows, tampered):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for j, r in enumerate(sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))):
            path = siblings(trees[s], j) + siblings(top, i)
            node = tampered(r)
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(d for a, b in path for d in a + b)), node, node == top[-1][0]))
    return sorted(out, key=str)


def query_tampering(r):
    if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2 or r["text"] is None:
        return leaf(r)
    return leaf(r, text=r["text"].replace("\n", ""))


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op11_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, query_tampering)


@pytest.mark.parametrize("levels_each", [1, 2, 6])
def test_odd_rows_in_any_number_of_rounds(odd, levels_each):
    # the many groups make a top tree of several levels; the large one a tree of its own height
    docs = odd.withColumn("source", F.when(F.col("doc_id") < 7, F.lit("big")).when(F.col("doc_id") < 9, F.lit("é")).when(F.col("doc_id") > 13, F.lit(None)).otherwise(F.concat(F.lit("s"), "doc_id")))
    docs = docs.unionByName(docs.where("doc_id < 7").withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(104)))))
    leaves = manifest.rows_of(docs, "source", "doc_id", COLUMNS, claimed={"text": F.lit("other")})
    built = manifest.build(leaves, levels_each)
    got = manifest.proofs(built, leaves.select("group", "rank", "claimed", "doc_id", "leaf"))
    got = [(r.doc_id, r.leaf, r.subroot, built.root.hex(), r.proof_sha256, r.folded_root, r.folded_root == built.root.hex()) for r in got.collect()]
    assert sorted(got, key=str) == plain(docs.collect(), lambda r: leaf(r, text="other"))
    assert {v for *_, v in got} == {False}
    # any part of the leaves, places that don't exist, and the path itself
    some = leaves.where("rank % 3 = 1").withColumn("claimed", F.col("leaf")).select("group", "rank", "claimed", F.col("leaf").alias("path"))
    some = some.unionByName(some.withColumn("rank", F.col("rank") + 1000))
    for r in manifest.proofs(built, some.withColumnRenamed("path", "own"), with_path=True).collect():
        assert r.folded_root == built.root.hex() and sha("".join(d for level in r.path for d in level)) == r.proof_sha256


def test_one_row_and_none(spark, odd, empty):
    one = odd.where("doc_id = 5")
    leaves = manifest.rows_of(one, "source", "doc_id", COLUMNS)
    built = manifest.build(leaves)
    r = manifest.proofs(built, leaves).collect()[0]
    assert built.root.hex() == r.subroot == r.folded_root == leaf(one.first()) and r.proof_sha256 == sha("")
    nothing = manifest.rows_of(empty, "source", "doc_id", COLUMNS)
    assert manifest.build(nothing).root is None and manifest.proofs(manifest.build(nothing), nothing, with_path=True).count() == 0
