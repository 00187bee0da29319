"""The n-gram join and components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from llm_fixtures import empty, odd  # noqa: F401
from rareflow.llm import ngram_join
from rareflow.llm.components import components

BLANK = " \t\n\x0b\x0c\r"


def shingles(text, size=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANK:
        low = low.replace(b, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, num=80, den=100):
    """[(doc_id, n, component)] of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near(seed, n_groups=12):
    """Groups of texts that differ in a few words, chains of them, and passages that unrelated texts share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3000)}"
    passage = [word() for _ in range(20)]
    texts = []
    for _ in range(n_groups):
        base = [word() for _ in range(r.randint(3, 80))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy = copy + passage
            texts.append(" ".join(copy))
            if r.random() < 0.5:
                base = copy  # a chain
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,block", [(1, 1 << 17), (2, 200), (3, 60)])
def test_groups_equal_brute_force(spark, seed, block):
    rows = near(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.similar_groups(docs, block_grams=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_other_similarity_and_size(spark):
    rows = near(5, 6)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=(1, 2), block_grams=100).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 1, 2)
    with pytest.raises(ValueError):
        ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=(3, 2))


def test_odd_rows(odd, empty):
    got = ngram_join.similar_groups(odd).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.similar_groups(empty).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ngram_join.similar_groups(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_search_finds_all_with_any_split_of_lists():
    import numpy as np

    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(60), r.randint(5, 40))), np.int64) for _ in range(80)]
    sizes = np.array([len(s) for s in sets])
    index = ngram_join.BlockIndex(sets, sizes)
    for mu in (1e-9, 0.0085, 0.5, 10):  # from as many long lists as can be to none
        ngram_join.MU, kept = mu, ngram_join.MU
        try:
            for i in (0, 7, 33):
                got = dict(index.search(sets[i], len(sets[i]), (1, 2), np.ones(80, bool)))
                want = {j: len(set(sets[i].tolist()) & set(s.tolist())) for j, s in enumerate(sets)}
                assert got == {j: o for j, o in want.items() if 2 * o >= len(sets[i]) + len(sets[j]) - o}
        finally:
            ngram_join.MU = kept


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (5, 5), (100, 101)] + [(200, 201 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100, **dict.fromkeys(range(200, 251), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
