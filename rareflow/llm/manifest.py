"""A Merkle manifest of a dataset: content-addressed nodes, leaf requests that descend from the root, proofs, verification.

A row's digest is its leaf. Within a group, leaves ascend; every ``WIDTH`` consecutive nodes become one by hashing their digests as hex
text, until one is left, the group's subroot; the subroots, by group, make a tree of the same kind with the root.

The store maps a node's digest to those of its children. Its records lie in rows of one *segment* each: a node and all
records up to ``levels`` levels below it, so that one join by digest brings a request that many levels down. A tree is built and
descended in as many rounds as it has segments from leaf to root (four for ten billion leaves of one group), and each round
shuffles a row for every ``WIDTH ** levels`` nodes of the round below it.

A request is a group's number and a leaf's rank. Requests with the same leading digits of the rank, in base ``WIDTH``, go down together:
at each node the next digit selects the child, and the children that it doesn't select are collected. The collected segments of the path,
reversed, are the proof from the leaf up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rareflow.llm.common import in_small_batches, kept
from rareflow.operators.ordered import BUCKET, in_ranges
from rareflow.session import work_path

WIDTH, LEVELS = 3, 6
RECORDS = "array<struct<digest:binary,children:array<binary>>>"


def digest(children: Sequence[bytes]) -> bytes:
    """SHA-256 of the children's digests as lower-case hex text."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (hex) of the values one after the other: ``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def levels_of(nodes: int, most: int = 64) -> int:
    """Levels above ``nodes`` nodes, ``most`` at most."""
    n = 0
    while nodes > 1 and n < most:
        nodes, n = -(-nodes // WIDTH), n + 1
    return n


def numbered(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``nodes`` (the number of rows) within each group; ties are numbered in any order, so they must be
    equal. Rows are dealt into ranges of the order, so that no group is in one task."""
    tagged = in_ranges(rows, *by, *order)
    window = Window.partitionBy(*[f"_{c}" for c in by])
    counts = tagged.groupBy(*by, BUCKET).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col(BUCKET).alias("_bucket"), "n")
    offsets = counts.select("*", (F.sum("n").over(window.orderBy("_bucket")) - F.col("n")).alias("_before"), F.sum("n").over(window).alias("nodes")).drop("n")
    same = F.col(BUCKET) == F.col("_bucket")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(*order)) - 1
    return tagged.withColumn("_place", place).join(offsets, same).select(*rows.columns, (F.col("_before") + F.col("_place")).alias("rank"), "nodes")


@dataclass
class Manifest:
    """Where a dataset's trees are stored. ``groups`` has (group number, group, nodes, subroot); ``segments`` and ``top_segments`` are the folders
    of the groups' trees and of the tree over them, by rounds from the leaves up; ``root`` is None without rows; a segment has ``levels`` levels."""

    spark: SparkSession
    groups: DataFrame
    segments: list[str]
    top_segments: list[str]
    root: bytes | None
    levels: int


def _segment(levels: int):
    """Rows (tree, place, nodes, digests) to the node above the digests and the records between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above, records = [], []
            for nodes, level in zip(batch.column("nodes").to_pylist(), batch.column("digests").to_pylist(), strict=True):
                own = {}
                for _ in range(levels_of(nodes, levels)):
                    runs = [level[i:i + WIDTH] for i in range(0, len(level), WIDTH)]
                    level = [digest(r) for r in runs]
                    own.update(zip(level, runs, strict=True))
                above.append(level[0])
                records.append([{"digest": k, "children": v} for k, v in own.items()])
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("place"), batch.column("nodes"), pa.array(above, pa.binary()), pa.array(records, kind)],
                                             names=["tree", "place", "nodes", "digest", "records"])

    return run


def _trees(leaves: DataFrame, levels: int) -> tuple[list[str], DataFrame]:
    """The segments' folders, from the leaves up, and the (tree, digest) left of each tree, given (tree, rank, nodes, digest)."""
    spark, size = leaves.sparkSession, WIDTH ** levels
    folders, tops, level = [], [], leaves
    while True:
        tops.append(level.where("nodes = 1").select("tree", "digest"))
        most = level.agg(F.max("nodes")).first()[0]
        if most is None or most == 1:
            return folders, tops[0] if len(tops) == 1 else kept(_union(tops), "subroots")
        rows = level.where("nodes > 1").groupBy("tree", "nodes", F.expr(f"rank div {size}").alias("place")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("d"))
        rows = in_small_batches(rows.select("tree", "place", "nodes", F.col("d.digest").alias("digests")))
        folders.append(work_path(spark, "segments"))
        rows.mapInArrow(_segment(levels), f"tree long, place long, nodes long, digest binary, records {RECORDS}").write.parquet(folders[-1])
        level = spark.read.parquet(folders[-1]).select("tree", F.col("place").alias("rank"), F.expr(f"(nodes + {size - 1}) div {size}").alias("nodes"), "digest")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rounds(nodes: Column, most: int, size: int) -> Column:
    """Segments from a leaf of a tree of so many leaves to its top: 0 for a lone leaf."""
    return sum((F.when(nodes > F.lit(size ** k), 1).otherwise(0) for k in range(most)), F.lit(0))


def build(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """The trees over leaves (group: number of the group, rank, nodes, leaf: hex), each group's ranks gapless from 0, and (tree, key) ascending.

    Equal leaves are nodes of their own in place, and share their record in the store. Without leaves there is no root.
    """
    spark = leaves.sparkSession
    own = leaves.select(F.col("group").alias("tree"), "rank", "nodes", F.unhex("leaf").alias("digest"))
    segments, subroots = _trees(own, levels)
    sizes = leaves.groupBy(F.col("group").alias("tree")).agg(F.max("nodes").alias("nodes"))
    groups = kept(subroots.join(sizes, "tree").select(F.col("tree").alias("group"), "nodes", F.col("digest").alias("subroot")), "groups")
    many = groups.count()
    top, root = _trees(groups.select(F.lit(0).cast("long").alias("tree"), F.col("group").alias("rank"), F.lit(many).cast("long").alias("nodes"), F.col("subroot").alias("digest")), levels)
    root = root.first()
    return Manifest(spark, groups, segments, top, root and bytes(root["digest"]), levels)


def _paths(top: bytes, records: dict[bytes, list[bytes]], levels: int, wanted: Sequence[int]) -> Iterator[tuple[int, bytes, list[list[bytes]]]]:
    """(place, digest, the children not selected on each level, from the top) of the wanted places ``levels`` levels below a node. Places that
    share leading digits share the descent to there."""
    known: dict[tuple[int, int], tuple[bytes, list]] = {(levels, 0): (top, [])}

    def node(level: int, place: int) -> tuple[bytes, list]:
        if (level, place) not in known:
            above, path = node(level + 1, place // WIDTH)
            children = records[above]
            digit = place % WIDTH
            known[level, place] = children[digit], [*path, children[:digit] + children[digit + 1:]]
        return known[level, place]

    for place in wanted:
        yield place, *node(0, place)


_PATH = pa.list_(pa.list_(pa.binary()))


def _down(frontier: DataFrame, folder: str, levels: int) -> DataFrame:
    """All nodes one round below (tree, place, nodes, digest, path): joined by digest to their segments and descended."""
    store, size = frontier.sparkSession.read.parquet(folder).select("digest", "records").dropDuplicates(["digest"]), WIDTH ** levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records = {r["digest"]: r["children"] for r in row["records"]}
                below = row["below"]
                found = list(_paths(row["digest"], records, levels_of(below, levels), range(min(size, below - row["place"] * size))))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n, pa.int64()), pa.array([row["place"] * size + p for p, _, _ in found], pa.int64()), pa.array([row["nodes"]] * n, pa.int64()),
                                                  pa.array([d for _, d, _ in found], pa.binary()), pa.array([row["path"] + path for _, _, path in found], _PATH)], names=["tree", "place", "nodes", "digest", "path"])

    rows = in_small_batches(frontier).join(store, "digest")
    return rows.mapInArrow(run, "tree long, place long, nodes long, digest binary, path array<array<binary>>")


def _descend(start: DataFrame, folders: list[str], levels: int, down_to: int = 0) -> DataFrame:
    """(tree, place, nodes, digest, path) of the nodes ``down_to`` rounds above the leaves, from (tree, nodes, digest, path): each tree is
    entered at its own height."""
    size = WIDTH ** levels
    high = rounds(F.col("nodes"), len(folders), size)
    entering = start.select("tree", F.lit(0).cast("long").alias("place"), "nodes", "digest", "path", high.alias("_high"))
    frontier = entering.where(F.col("_high") == len(folders)).drop("_high")
    for k in range(len(folders) - 1, down_to - 1, -1):
        below = "nodes"  # nodes of the tree on the level that this round reaches
        for _ in range(k):
            below = f"({below} + {size - 1}) div {size}"
        frontier = kept(_down(frontier.withColumn("below", F.expr(below)), folders[k], levels), "frontier")
        frontier = frontier.unionByName(entering.where(F.col("_high") == k).drop("_high"))
    return frontier.unionByName(entering.where(F.col("_high") < down_to).drop("_high")) if down_to else frontier


def proofs(manifest: Manifest, requests: DataFrame, with_path: bool = False) -> DataFrame:
    """Every request (group, rank, claimed: hex of the leaf to be checked, other columns) with subroot, proof_sha256 (of the digests not selected,
    in hex, from the leaf's level to the root, left to right), folded_root (hex) and, if asked for, the path: these digests level by level.

    The proof is that of the stored leaf; ``folded_root`` is what the claimed leaf and it give. Requests may name any part of the leaves, in any
    order, and repeatedly (those of one segment are answered together); those for places that don't exist give no row.
    """
    if manifest.root is None:
        return requests.limit(0).drop("group", "rank", "claimed").selectExpr("*", "'' as subroot", "'' as proof_sha256", "'' as folded_root", *["array(array('')) as path"] * with_path)
    spark, many, levels, segment = manifest.spark, manifest.groups.count(), manifest.levels, WIDTH ** manifest.levels
    start = spark.createDataFrame([(0, many, bytearray(manifest.root), [])], "tree long, nodes long, digest binary, path array<array<binary>>")
    tops = _descend(start, manifest.top_segments, levels).select(F.col("place").alias("tree"), "digest", "path")
    trees = tops.join(manifest.groups.select(F.col("group").alias("tree"), F.col("nodes")), "tree")
    trees = kept(trees.select("tree", "nodes", "digest", "path", F.col("digest").alias("subroot")), "trees")
    others = [c for c in requests.columns if c not in ("group", "rank", "claimed")]
    # lone leaves and the last round: requests of one segment meet its records and are answered together
    asked = requests.groupBy(F.col("group").alias("tree"), F.expr(f"rank div {segment}").alias("place")).agg(
        F.collect_list(F.struct("rank", F.unhex("claimed").alias("claimed"), *others)).alias("asked"))
    if manifest.segments:
        last = _descend(trees.drop("subroot"), manifest.segments, levels, down_to=1)
        store = spark.read.parquet(manifest.segments[0]).select("digest", "records").dropDuplicates(["digest"])
        last = last.join(store, "digest", "left")
    else:
        last = trees.selectExpr("tree", "0L as place", "nodes", "digest", "path", f"cast(null as {RECORDS}) as records")
    rows = in_small_batches(asked).join(last, ["tree", "place"]).join(trees.select("tree", "subroot"), "tree")
    fields = requests.select(*others).schema
    shape = pa.schema([*[(f.name, _arrow(f.dataType)) for f in fields], ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()),
                       *[("path", pa.list_(pa.list_(pa.string())))] * with_path])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records = {r["digest"]: r["children"] for r in row["records"] or ()}
                inside = levels_of(row["nodes"])
                wanted = [a["rank"] - row["place"] * segment for a in row["asked"]]
                size = min(segment, row["nodes"] - row["place"] * segment)
                found = {p: path for p, _, path in _paths(row["digest"], records, levels_of(row["nodes"], levels), sorted({w for w in wanted if 0 <= w < size}))}
                out = []
                for a, w in zip(row["asked"], wanted, strict=True):
                    if w not in found:
                        continue
                    proof = (row["path"] + found[w])[::-1]
                    node, place = a["claimed"], a["rank"]
                    for level, others_here in enumerate(proof):
                        if level == inside:
                            place = row["tree"]
                        digit = place % WIDTH
                        place //= WIDTH
                        node = digest([*others_here[:digit], node, *others_here[digit:]])
                    flat = [d for level in proof for d in level]
                    out.append({**a, "subroot": row["subroot"].hex(), "proof_sha256": digest(flat).hex(), "folded_root": node.hex(),
                                **({"path": [[d.hex() for d in level] for level in proof]} if with_path else {})})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{kinds + ', ' if kinds else ''}subroot string, proof_sha256 string, folded_root string" + ", path array<array<string>>" * with_path)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def rows_of(docs: DataFrame, group_col: str, order_col: str, columns: Sequence[str], claimed: dict[str, Column] | None = None) -> DataFrame:
    """(group: its number, null first, rank, nodes, leaf, claimed, and the order column) of every row, as a table: a leaf is the digest of ``columns`` in this
    order, ``claimed`` the digest with some of them replaced, where the stored row is to be checked against another one.

    Rows of a group ascend by the order column (null first), and by their leaf where it ties; repeated rows are leaves of their own. Null and empty
    texts have different digests. Columns that aren't named are not read.
    """
    leaf = leaf_digest(*[docs[c] for c in columns])
    other = leaf_digest(*[(claimed or {}).get(c, docs[c]) for c in columns]) if claimed else leaf
    rows = kept(docs.select(docs[group_col].cast("string").alias("_group"), docs[order_col].alias(order_col), leaf.alias("leaf"), other.alias("claimed")), "leaves")
    groups = kept(numbered(rows.select("_group").distinct(), [], "_group").select(F.col("_group").alias("_name"), F.col("rank").alias("group")), "group-numbers")
    ranked = numbered(rows, ["_group"], order_col, "leaf")
    return kept(ranked.join(groups, F.col("_group").eqNullSafe(F.col("_name"))).drop("_group", "_name"), "ranked-leaves")
