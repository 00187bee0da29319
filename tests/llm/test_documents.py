"""Quality classifier, quality rules, shards and mixing against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from llm_fixtures import SCHEMA, empty, odd, prose  # noqa: F401
from rareflow.llm import mixing, preference, quality_rules, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- preference ------------------------------------------------------------------

def test_learns_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op1_preference_quality(spark, SF).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    unseen = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in unseen]) > 0.9


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(preference.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = preference.learn(docs, labels), preference.learn(docs.withColumn("source", F.lit("z")), turned)
    assert np.array_equal(a.weight, b.weight) and a.threshold == b.threshold


def marked(spark, n, rare=5):
    rows = [(i, " ".join(["good words", "in", "some order"][: 1 + i % 3] * (1 + i % 4)) + (" | || !!" if i % rare == 0 else f" end{i % 7}.")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % rare > 0)) for i in range(n)], "doc_id long, quality int")


def test_every_labelled_document_is_learnt_from(spark):
    docs, labels = marked(spark, 400)
    taken = {r.doc_id: r.text for r in docs.where(~preference.held_out(F.col("doc_id"))).collect()}
    x = preference.features([t.encode() for t in taken.values()])
    good = np.array([i % 5 > 0 for i in taken])
    whole, blocks = preference.learn(docs, labels), preference.learn(docs, labels, 16)
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).collect() if r.doc_id in taken]
    alone = preference.fit(preference.features([taken[i].encode() for i in order]), np.array([int(i % 5 > 0) for i in order]))
    assert np.allclose(whole.weight, alone.weight, atol=1e-6) and np.isclose(whole.threshold, alone.threshold)
    for ranker in (whole, blocks):
        assert np.allclose(ranker.centre, x.mean(axis=0)) and np.allclose(ranker.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
        s = ((x - ranker.centre) / ranker.scale) @ ranker.weight
        assert np.isclose(ranker.threshold, np.quantile(s, 1 - good.mean()))
        assert s[good].min() > s[~good].max()


def test_rows_of_a_rare_label_serve_many_blocks(spark):
    docs, labels = marked(spark, 300, rare=60)
    seen = []
    for block in (8, 1024):
        ranker = preference.learn(docs, labels, block)
        seen.append(ranker)
        score = {r.doc_id: r.score for r in preference.scored(docs, ranker).collect()}
        assert all(score[i] < min(v for k, v in score.items() if k % 60) for i in range(0, 300, 60))
    assert np.allclose(seen[0].centre, seen[1].centre) and np.allclose(seen[0].scale, seen[1].scale)


def test_texts_are_measured_before_labels_are_joined(spark, monkeypatch):
    docs, labels = marked(spark, 200)
    more = docs.unionByName(spark.createDataFrame([(i, "unmarked || text " * (i or 1)) for i in (None, None, 1000, 1001, 1001)], docs.schema))
    plans, kept = {}, preference.kept

    def seen(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        return kept(frame, name)

    monkeypatch.setattr(preference, "kept", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for labels too large to broadcast
    try:
        some = preference.learn(more, labels.unionByName(spark.createDataFrame([(None, 1), (5000, 0)], labels.schema)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plans["preference-features"]
    at = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    depth = plan[at].index("MapInArrow")
    below = list(itertools.takewhile(lambda line: len(line) - len(line.lstrip(" :+-")) > depth, plan[at + 1:]))
    assert any("SortMergeJoin" in line for line in plan[:at]) and below and not any("Exchange" in line or "Join" in line for line in below)
    plain = preference.learn(docs, labels)
    assert np.allclose(some.weight, plain.weight) and np.allclose(some.centre, plain.centre) and np.isclose(some.threshold, plain.threshold)


def test_threshold_is_a_quantile_and_preferences_hold():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    label = (x[:, 0] - x[:, 2] > 0.5).astype(int)
    ranker = preference.fit(x, label)
    score = ranker.score(x)
    assert abs((score < preference.CUT).mean() - (label == 0).mean()) < 0.01
    good, bad = score[label == 1], score[label == 0]
    assert (good[:, None] > bad).mean() > 0.99
    flat = preference.fit(x, np.ones(400))
    assert np.allclose(flat.score(x), preference.CUT) and (flat.score(x) >= preference.CUT).all()


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (3, 1), (8, 0), (9, 0), (14, None), (None, 1), (11, 1), (11, 0), (15, 2)], "doc_id long, quality int")
    ranker = preference.learn(odd, labels)
    rows = preference.scored(odd, ranker).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and set(preference.scored(odd, ranker).columns) == set(odd.columns)
    assert len({r.score for r in rows if not r.text}) == 1  # null and empty alike
    assert preference.scored(empty, ranker).count() == 0
    nothing = preference.learn(empty, labels)
    assert {r.score for r in preference.scored(odd, nothing).collect()} == {preference.CUT}


def test_features_do_not_depend_on_neighbours():
    items = [t.encode() for t in (prose(1, 30), "", "The The The", "a!! B!! c|", prose(2, 3), "日本 é")]
    together = preference.features(items)
    assert np.array_equal(together, np.concatenate([preference.features([t]) for t in items]))


# --- quality rules -----------------------------------------------------------------

def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def shares(text, vocab):
    words = WORD.findall(text)
    low = Counter(w.lower() for w in words)
    counts = [low[v] for v in vocab]
    chars = "".join(words)
    import unicodedata

    kinds = [sum(unicodedata.category(c) == "Lu" for c in chars), sum(unicodedata.category(c) == "Nd" for c in chars),
             sum(c in ".,;:?'\"()-" for c in chars), sum(c in "#*$%&|<>" for c in chars)]
    lower = sum(unicodedata.category(c) == "Ll" for c in chars)
    return ([c / len(words) for c in counts] + [(len(words) - sum(counts)) / len(words)],
            [k / len(chars) for k in [*kinds, len(chars) - sum(kinds) - lower, lower]])


def js(p, q):
    total = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True))
    return math.sqrt(max(total / 2, 0))


def verdicts(rows):
    """doc_id -> (base counts, distances, kept) of (doc_id, lang, text) rows."""
    vocab = quality_rules.vocabulary(quality_rules.COMMON)
    sums = {}
    for _, lang, text in rows:
        n, *_, repeated = base(text)
        if lang in quality_rules.COMMON and n >= max(quality_rules.MIN_WORDS, 20) and 100 * repeated <= 30 * n:
            sums.setdefault(lang, []).append(shares(text, vocab))
    refs = {k: [np.mean([x[i] for x in v], axis=0).tolist() for i in (0, 1)] for k, v in sums.items()}
    out = []
    for doc, _, text in rows:
        counts = base(text)
        n = counts[0]
        failed = n < 20 or 100 * counts[4] > 30 * n
        far = [min(js(shares(text, vocab)[i], r[i]) for r in refs.values()) for i in (0, 1)] if n >= quality_rules.MIN_WORDS and refs else None
        strays = far is not None and (far[0] > quality_rules.MAX_WORD_DISTANCE + quality_rules.NOISE / math.sqrt(n) or far[1] > quality_rules.MAX_CLASS_DISTANCE)
        out.append((doc, counts, far, failed, not failed and not strays))
    return out


def compare(got, want):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.word_distance, r.class_distance, r.base_failed, r.kept) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[4:] == w[3:], (g, w)
        assert (g[2] is None) == (w[2] is None) and (w[2] is None or np.allclose(g[2:4], w[2], atol=6e-7)), (g, w)


def test_rules_of_the_table(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()]
    compare(queries.op10_divergence_rules(spark, SF).collect(), verdicts(rows))


def test_rules_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.lang, r.text) for r in odd.select("doc_id", "lang", "text").collect()]
    found = quality_rules.judge(odd, quality_rules.references(odd))
    compare(found.collect(), verdicts(rows))
    assert len(found.columns) == len(set(found.columns)) and set(odd.columns) <= set(found.columns)
    left = quality_rules.filtered(odd, quality_rules.references(odd))
    assert left.columns == odd.columns and left.count() == found.where("kept").count()
    assert quality_rules.references(empty) == {} and quality_rules.judge(empty, {}).count() == 0
    assert {r.word_distance for r in quality_rules.judge(odd, {}).collect()} == {None}


def test_repeated_windows(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(200)] + [" ".join(["x"] * n) for n in range(7, 12)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality_rules.judge(rows, {}).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


# --- shards ------------------------------------------------------------------------

def test_shards(spark):
    rows = queries.op7_slot_shards(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by, load = {}, Counter()
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    even = sum(load.values()) / 40
    assert max(load.values()) <= max(1.02 * even, max(r["size"] for r in rows)) and len(load) == 40


def test_shards_of_odd_rows_and_ranks_in_parts(spark, odd, empty, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "RANK_ROWS", 1)
    rows = sharding.shard(odd, 3, slots=8, folder=f"file://{tmp_path}/m").collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(empty, 3, slots=8).count() == 0
    maps = {v: {r.v_slot: r.shard for r in sharding.load_map(spark, f"file://{tmp_path}/m/map", v).collect()} for v in (1, 2)}
    assert maps[1] == {i: i % 3 for i in range(8)} and set(maps[2]) == set(range(8))
    assert {r.v_slot: r.shard for r in sharding.load_map(spark, f"file://{tmp_path}/m/map").collect()} == maps[2]


def test_an_edit_moves_little_and_grows(spark):
    r = random.Random(1)
    sizes = {i: r.randint(1, 100) for i in range(256)}
    weights = spark.createDataFrame(list(sizes.items()), "v_slot int, bytes long")
    old = sharding.first_map(spark, 8, 256)
    new = sharding.rebalanced(old, weights, 8)
    a, b = ({x.v_slot: x.shard for x in m.collect()} for m in (old, new))
    load = Counter()
    for s, shard in b.items():
        load[shard] += sizes[s]
    moved = lambda x, y: sum(sizes[s] for s in x if x[s] != y[s]) / sum(sizes.values())
    assert max(load.values()) - min(load.values()) <= 20 and moved(a, b) < 0.2
    grown = {x.v_slot: x.shard for x in sharding.rebalanced(new, weights, 9).collect()}
    assert set(grown.values()) == set(range(9)) and moved(b, grown) < 0.15
    shrunk = {x.v_slot: x.shard for x in sharding.rebalanced(new, weights, 4).collect()}
    assert set(shrunk.values()) == set(range(4))


def test_rules_let_languages_without_a_reference_pass(spark):
    words = "il gatto nero dorme sotto una sedia vecchia mentre fuori piove molto forte sulla strada deserta".split()
    r = random.Random(4)
    italian = " ".join(r.choice(words) + r.choice(["", "", "re", "ti"]) for _ in range(120))
    common = quality_rules.COMMON["en"]
    english = [" ".join(r.choice(common) if i % 3 else f"word{r.randint(1, 900)}" for i in range(120)) for _ in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(english)] + [(20, italian, "it"), (21, italian, "en"), (22, italian, None), (23, "troppo corto", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.references(docs.where("doc_id < 20"))
    judged = {x.doc_id: x.kept for x in quality_rules.judge(docs, refs).collect()}
    assert judged[20] and not any(judged[i] for i in (21, 22, 23)) and all(judged[i] for i in range(12))
    assert {x.doc_id for x in quality_rules.filtered(docs, refs).collect()} == {*range(12), 20}
    assert not any(x.kept for x in quality_rules.judge(docs.drop("lang"), refs).collect() if x.doc_id > 12)


# --- mixing ------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(8))
def test_every_prefix_is_within_one_block(seed):
    r = random.Random(seed)
    weights = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
    places, total = mixing.order(weights), sum(weights)
    assert sorted(x for p in places for x in p) == list(range(total)) and [len(p) for p in places] == weights
    for w, p in zip(weights, places, strict=True):
        for t in range(total + 1):
            assert abs(sum(x < t for x in p) - w * t / total) < 1
        for k, slot in enumerate(p):
            assert k * total // w <= slot < -(-(k + 1) * total // w)


def test_stretches_keep_the_shares_of_the_sources_left():
    rows, weights = {"a": 1000, "b": 130, "c": 7, "d": 0}, {"a": 3, "b": 2, "c": 2, "d": 1}
    slots = {}
    for s, first, last, start, period, places, missing in mixing.stretches(weights, rows, 10):
        for k in range(last - first + 1):
            slot = start + k // len(places) * period + places[k % len(places)]
            assert slot not in slots
            slots[slot] = (s, first + k)
    assert sorted(slots) == list(range(100 + 13 + 1))
    assert Counter(s for s, _ in slots.values()) == {"a": 100, "b": 13, "c": 1}
    for s in "abc":
        assert [k for t, (x, k) in sorted(slots.items()) if x == s] == list(range(-(-rows[s] // 10)))


def test_mixing_of_the_table(spark):
    rows = sorted(queries.op9_pfair_mixing(spark, SF).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(spark.read.parquet(f"{SF}/documents.parquet").count()))
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    for slot, many in Counter(r.slot for r in rows).items():
        assert many <= mixing.BLOCK_ROWS and len({(r.source, r.block) for r in rows if r.slot == slot}) == 1


def test_mixing_of_many_sources_and_fine_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_AT_ONCE", 700, raising=False)
    monkeypatch.setattr(mixing, "REPEATS", 4, raising=False)
    docs = spark.range(6000).selectExpr("id", "case when id < 3000 then 'big' when id < 4000 then 'mid' else concat('host', id % 1500) end as source")
    rows = sorted(mixing.mix(docs, block_rows=2).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(6000)) and len({r.id for r in rows}) == 6000
    shares = {"big": 300_001, "mid": 100_000}
    rows = sorted(mixing.mix(docs.where("id < 4000"), shares, block_rows=2).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(4000)) and {(r.source, r.weight) for r in rows} == set(shares.items())
    for n in range(0, 4000, 250):  # three to one within a block, until both end
        assert abs(sum(r.source == "mid" for r in rows[:n]) - n / 4) <= 2


def test_mixing_of_odd_rows(odd, empty):
    mixed = mixing.mix(odd, {"s0": 3, None: 2}, block_rows=2)
    rows = sorted(mixed.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(odd.count())) and set(mixed.columns) == set(odd.columns) | {"weight", "block", "slot", "position"}
    assert {(r.source, r.weight) for r in rows} == {("s0", 3), ("s1", 1), (None, 2)}
    assert Counter(str(r.doc_id) for r in rows) == Counter(str(r.doc_id) for r in odd.collect())
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"s0": 0})
    with pytest.raises(ValueError):
        mixing.mix(odd, {"s0": mixing.MOST_WEIGHT + 1})
