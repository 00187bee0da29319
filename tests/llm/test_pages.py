"""Revisits and top-k against brute force, the pipeline stage by stage, and the SQL twins."""

import random
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from llm_fixtures import empty, odd  # noqa: F401
from rareflow.llm import queries, quality_rules, revisits, topk


@pytest.mark.parametrize("url,key", [
    ("HTTP://www.Example.org:80/a/b/?utm_source=x&z=1&b=2#top", "example.org/a/b?b=2&z=1"), ("https://m.example.org/a/index.html", "example.org/a"),
    ("example.org", "example.org"), ("https://u:p@example.org/x.html?ref=1", "example.org/x"), ("https://example.org/?q=a&q=a", "example.org?q=a&q=a"), ("", ""), (None, None)])
def test_canonical(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(revisits.canonical(__import__("pyspark.sql.functions").sql.functions.col("u"))).first()[0] == key


def brute_revisits(rows):
    tag = lambda h: (h or {}).get("etag", "").removeprefix("W/") or None
    day = lambda h: (h or {}).get("last-modified") or None
    out = {}
    for i, url, ts, status, h in rows:
        if status != 304:
            continue
        if url is None or ts is None:
            out[i] = ("no_url", None, h or {})
            continue
        before = [r for r in rows if r[3] == 200 and r[1] == url and r[2] is not None and r[2] < ts]
        if not before:
            out[i] = ("no_earlier_response", None, h or {})
            continue
        m = max(before, key=lambda r: (r[2], r[0]))
        same = tag(h) == tag(m[4]) if tag(h) else day(h) == day(m[4]) if day(h) else tag(m[4]) is None and day(m[4]) is None
        if not same:
            out[i] = ("validator_mismatch", None, h or {})
            continue
        out[i] = ("resolved", m[0], (m[4] or {}) | {k: v for k, v in (h or {}).items() if k in revisits.PERMITTED})
    return out


def test_revisits_equal_brute_force(spark):
    r = random.Random(2)
    tags = [None, {}, {"etag": '"a"'}, {"etag": 'W/"a"', "date": "d"}, {"etag": '"b"', "content-type": "t"}, {"last-modified": "x", "expires": "e"}, {"last-modified": "y"}]
    rows = [(i, r.choice(["hot.org/", "hot.org/", "u1.org/", "u2.org/", None]), r.choice([None, *range(30)]), r.choice([200, 200, 304, 304, 404]), r.choice(tags)) for i in range(600)]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>").selectExpr("*", "1 as part", "2 as state").repartition(5)
    got = {x.record_id: (x.state, x.matched_id, x.headers) for x in revisits.resolve(frame).collect()}
    assert got == brute_revisits(rows)
    assert revisits.resolve(frame.where("false")).count() == 0


def brute_top(rows, every, k):
    v = {i: np.floor(64 * np.array(x, float)).astype(int) for i, x in enumerate(r[1] for r in rows)}
    out = []
    for i, (q, _) in enumerate(rows):
        if q % every == 0:
            near = sorted((-int(v[i] @ v[j]), c) for j, (c, _) in enumerate(rows) if j != i)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near)]
    return sorted(out)


def test_header_names_in_any_case(spark):
    rows = [(1, "a.org/x", 10, 200, {"ETag": "one", "Content-Type": "t", "Last-Modified": "d"}), (2, "a.org/x", 20, 304, {"ETAG": "two"}),
            (3, "a.org/x", 30, 304, {"Etag": "W/one", "Cache-Control": "c"}), (4, "a.org/x", 40, 304, {"LAST-MODIFIED": "e"}),
            (5, "a.org/x", 50, 304, {"ETag": "two", "etag": "one", "ETAG": "three"}), (6, "a.org/x", 60, 304, None)]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    got = {x.record_id: (x.state, x.headers) for x in revisits.resolve(frame).collect()}
    whole = {"etag": "one", "content-type": "t", "last-modified": "d"}
    assert got == {2: ("validator_mismatch", {"etag": "two"}), 3: ("resolved", whole | {"etag": "W/one", "cache-control": "c"}),
                   4: ("validator_mismatch", {"last-modified": "e"}), 5: ("resolved", whole), 6: ("validator_mismatch", {})}


@pytest.mark.parametrize("shard_rows,leaf_rows,together", [(1000, 256, 8), (60, 8, 2), (25, 1, 1)])
def test_top_k_equals_brute_force(spark, shard_rows, leaf_rows, together):
    r = np.random.default_rng(shard_rows)
    x = np.round(r.normal(size=(300, 6)), 1)
    x[50:90] = x[50]  # ties
    x[200:] *= 3
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.top_k(frame, every=20, k=7, shard_rows=shard_rows, leaf_rows=leaf_rows, together=together).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20, 7)


def test_top_k_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "2 as score", "3 as block")
    good = [(i, [*v, 0.0, 0.0][:2]) for i, v in rows if i in (0, 20, 5, 6)]
    for shard_rows in (100, 2):
        assert sorted(map(tuple, topk.top_k(frame, shard_rows=shard_rows).collect())) == brute_top(good, 20, 20)
    assert topk.top_k(frame.where("false")).count() == 0


@pytest.mark.parametrize("together", [1, 8])
def test_top_k_of_equal_rows(spark, together):
    for rows in ([(20, [1.0, 2.0])] * 20, [(20, [1.0, 2.0])] * 18 + [(40, [3.0, 1.0]), (7, [1.0, 1.0])]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk.top_k(frame, k=20, shard_rows=5, together=together, scale=1).collect()
        assert sorted(map(tuple, got)) == sorted((*x[:3], x[3] // 64 // 64) for x in brute_top(rows, 20, 20))


def test_top_k_sends_few_shards_of_clustered_rows(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres, sent, shards = r.normal(size=(12, 16)), [], []
    plain = topk.kept

    def counted(frame, name):
        out = plain(frame, name)
        if name in ("pairs", "shards"):
            (sent if name == "pairs" else shards).append(out.count())
        return out

    monkeypatch.setattr(topk, "kept", counted)
    x = centres[r.integers(0, 12, 1200)] + 0.05 * r.normal(size=(1200, 16))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(frame, k=20, shard_rows=50, leaf_rows=16, together=2).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20, 20)
    assert shards[0] >= 24 and sum(sent) < 0.4 * shards[0] * (shards[0] - 1)


def test_top_k_of_a_row_repeated_often(spark):
    rows = [(20, [1.0, 2.0])] * 300 + [(20, [1.0, 1.0])] * 3 + [(i, [2.0, i % 3 / 2]) for i in range(100, 130)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, topk.top_k(frame, k=5, shard_rows=8, leaf_rows=3).collect())) == brute_top(rows, 20, 5)


def test_cells_and_trees_of_odd_samples():
    for x in (np.zeros((9, 3)), np.array([[0.0], [0.0], [7.0]]), np.zeros((1, 0)), np.arange(64.0).reshape(32, 2)):
        cells = topk.Cells(x, 4)
        assert set(cells.of(x)) <= set(range(cells.cells)) and len(cells.of(np.zeros((0, 5)))) == 0
        tree, order = topk.BallTree.of(x, 2)
        leaves = sorted(zip(tree.begin[tree.leaves], tree.end[tree.leaves], strict=True))
        assert [a for a, _ in leaves] == [0, *(b for _, b in leaves)][:-1] and leaves[-1][1] == len(x) and sorted(order) == list(range(len(x)))
        q = np.ones((2, x.shape[1]))
        _, bound = tree.leaf_bounds(q, np.full(2, -np.inf))
        for (a, b), high in zip([(tree.begin[i], tree.end[i]) for i in tree.leaves], bound[0], strict=True):
            assert (x[order[a:b]] @ q[0]).max() <= high


def test_pipeline_stages(spark, odd, empty, tmp_path):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = f"{tmp_path}/{n}"
        stage(spark, before, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = (before, docs)
        if n < 4:
            assert docs.columns == before.columns
    ids = lambda f: {r.doc_id for r in f.select("doc_id").collect()}
    before, after = seen["quality classifier"]
    assert ids(after) == {r.doc_id for r in queries.op1_preference_quality(spark, SF).collect() if r.predicted}
    before, after = seen["quality rules"]
    assert ids(after) == {r.doc_id for r in quality_rules.judge(before, quality_rules.references(before)).collect() if r.kept}
    before, after = seen["n-gram Jaccard join"]
    from test_join import brute

    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {d for d, _, c in groups if d == c}
    before, after = seen["mixing sources to target weights"]
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    before, after = seen["best-fit packing"]
    assert ids(after) == ids(before) and all(r.length + r.offset <= 1024 for r in after.collect())


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*columns, "row", "grams"), empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_sequences_follow_the_weights_of_the_mix(spark, monkeypatch):
    import corpus_pipeline

    r = np.random.default_rng(5)
    sources = ["a"] * 2000 + ["b"] * 700 + ["c"] * 300
    rows = [(i, " ".join(["tok"] * int(r.integers(1, 1500))), "en", s, 0) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)

    def sequences():
        return corpus_pipeline.packed(spark, docs, SF).collect()

    tempered, again = sequences(), sequences()
    assert sorted(map(tuple, tempered)) == sorted(map(tuple, again))
    monkeypatch.setattr(corpus_pipeline, "MIX", {"weights": {"a": 1, "b": 1, "c": 2}})
    given = sequences()
    assert sorted(map(tuple, given)) != sorted(map(tuple, tempered))
    for got, share in ((tempered, {"a": 0.49, "b": 0.29, "c": 0.22}), (given, {"a": 0.25, "b": 0.25, "c": 0.5})):
        at, ids = {}, {x.sequence_id for x in got}
        for x in got:
            at.setdefault(x.sequence_id, []).append((x.offset, x.length))
        assert ids == set(range(len(ids))) and Counter(x.doc_id for x in got).keys() == set(range(3000))
        for places in at.values():  # gapless, and within the capacity
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:], strict=False)) and sum(n for _, n in places) <= 1024
        early = Counter()  # the first sixth, in which no source ends
        for x in got:
            if x.sequence_id < len(ids) / 6:
                early[sources[x.doc_id]] += x.length
        assert all(abs(early[s] / early.total() - w) < 0.1 for s, w in share.items()), (early, share)
