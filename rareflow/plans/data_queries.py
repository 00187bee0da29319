"""Queries for validation, accounting, class weights, splits, sampling and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareflow.operators import sampling as S
from rareflow.operators import validate as V
from rareflow.plans.registry import md5_hash_sql, register
from rareflow.plans.views import (
    ORDERS_LABEL, ORDERS_SQL, TX_DIRTY_SQL, TX_FEATURES, TX_KEY, TX_MISSING_SQL, TX_SPEC,
    TX_SQL, orders_labelled, table, tx, tx_dirty, tx_missing,
)

TX_COLS = ", ".join([*TX_KEY, *TX_FEATURES, "y", "y2", "s"])


def _fin(c: str) -> str:
    return f"({c} is not null and not isnan({c}) and not isinf({c}))"


BAD_SQL = "(not coalesce(y::double in (1.0, 0.0), false) or " + " or ".join(
    f"not {_fin(c + '::double')}" for c in [*TX_FEATURES, "y"]) + ")"
MISSING_SQL = "(" + " or ".join(f"{c} is null or isnan({c}::double)" for c in [*TX_FEATURES, "y"]) + ")"


@register("validate_rows", "with " + TX_DIRTY_SQL + f"""
select count(*) as rows, count(*) filter (where {BAD_SQL}) as bad_rows,
       count(*) filter (where y = 1) as positives, count(*) filter (where y = 0) as negatives
from txd""")
def q_validate_rows(spark, d):
    return V.validate_rows(tx_dirty(spark, d), TX_SPEC)


@register("row_accounting", "with " + TX_DIRTY_SQL + f"""
select count(*) as input_rows, count(*) filter (where not {MISSING_SQL}) as valid_rows,
       count(*) filter (where {MISSING_SQL}) as dropped_rows
from txd""")
def q_row_accounting(spark, d):
    return V.row_accounting(tx_dirty(spark, d), TX_SPEC)


@register("clean_rows", "with " + TX_MISSING_SQL + f"""
select {TX_COLS} from txm where not {MISSING_SQL}""")
def q_clean_rows(spark, d):
    return V.clean_rows(tx_missing(spark, d), TX_SPEC)


@register("require_both_classes", "with " + TX_SQL + """
select count(*) filter (where y2 = 1) as positives, count(*) filter (where y2 = 0) as negatives,
       count(*) filter (where y2 = 1) > 0 and count(*) filter (where y2 = 0) > 0 as both_classes
from tx""")
def q_require_both_classes(spark, d):
    return V.class_presence(tx(spark, d), "y2")


@register("class_counts", "with " + TX_SQL + " select y as label, count(*) as n from tx group by y")
def q_class_counts(spark, d):
    return V.class_counts(tx(spark, d), "y")


@register("class_weights", "with " + TX_SQL + """,
c as (select y2 as label, count(*) as n from tx group by y2),
t as (select *, sum(n) over () as total from c)
select label, n, 1.0::double as weight_none, total::double / (2.0::double * n::double) as weight_balanced,
       sqrt(total::double / (2.0::double * n::double)) as weight_sqrt_balanced
from t""")
def q_class_weights(spark, d):
    return V.class_weights(tx(spark, d), "y2")


@register("apply_class_weights", "with " + TX_SQL + """,
c as (select count(*) filter (where y2 = 0) as n0, count(*) filter (where y2 = 1) as n1 from tx)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, y2,
       case when y2 = 1 then (n0 + n1)::double / (2.0::double * n1::double)
            else (n0 + n1)::double / (2.0::double * n0::double) end as class_weight
from tx, c""")
def q_apply_class_weights(spark, d):
    t = tx(spark, d)
    w = V.training_class_weights(V.counts_dict(t, "y2"), "balanced")
    return V.apply_class_weights(t.select(*TX_KEY, "y2"), "y2", w)


@register("project_features", "with " + TX_SQL + f" select {', '.join(TX_FEATURES)}, y from tx")
def q_project_features(spark, d):
    return V.project_features(tx(spark, d), TX_SPEC)


@register("cast_numeric", """
select l_orderkey::double as l_orderkey, l_linenumber::double as l_linenumber, l_quantity,
       try_cast(l_returnflag as double) as l_returnflag
from lineitem""")
def q_cast_numeric(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return V.cast_numeric(li, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])


@register("filter_class", "with " + TX_SQL + f" select {TX_COLS} from tx where y2 = 1")
def q_filter_class(spark, d):
    return V.filter_class(tx(spark, d), "y2", 1)


SPLIT_SQL = f"""case when {md5_hash_sql('o_orderkey', seed=42)} % 100 >= 80 then 'test'
            when {md5_hash_sql('o_orderkey', seed=43)} % 100 >= 80 then 'validation'
            else 'train' end"""
SPLIT_CTE = ORDERS_SQL + f""",
sp as (select *, {SPLIT_SQL} as split from ol)"""


def _split(spark, d):
    return S.hash_split(orders_labelled(spark, d), ["o_orderkey"])


@register("hash_split", f"with {SPLIT_CTE} select * from sp")
def q_hash_split(spark, d):
    return _split(spark, d)


@register("split_class_counts", f"""with {SPLIT_CTE}
select split, urgent as label, count(*) as n from sp group by split, urgent""")
def q_split_class_counts(spark, d):
    return S.split_class_counts(_split(spark, d), ORDERS_LABEL)


@register("split_disjointness", f"""with {SPLIT_CTE}
select count(*) as source_rows,
       count(*) filter (where split = 'train') as train_rows,
       count(*) filter (where split = 'validation') as validation_rows,
       count(*) filter (where split = 'test') as test_rows,
       0::bigint as overlapping_keys, 0::bigint as missing_keys, 0::bigint as extra_keys
from sp""")
def q_split_disjointness(spark, d):
    src = orders_labelled(spark, d)
    train, val, test = S.split_frames(S.hash_split(src, ["o_orderkey"]))
    return S.split_disjointness(src, {"train": train, "validation": val, "test": test}, ["o_orderkey"])


@register("nested_split", "with " + ORDERS_SQL + """
select count(*) as source_rows, count(*) as part_rows, 0::bigint as overlapping_keys, 0::bigint as missing_keys, 0::bigint as extra_keys,
       true as train_share_ok, true as validation_share_ok, true as test_share_ok
from ol""")
def q_nested_split(spark, d):
    """The three parts of a frame that comes out of a shuffle cover it, no key is in two of them, and their shares are near 64, 16 and 20 %."""
    src = orders_labelled(spark, d)
    parts = dict(zip(S.SPLITS, S.nested_split(src.repartition("o_custkey")), strict=True))
    rep, near = S.split_disjointness(src, parts, ["o_orderkey"]), {"train": 0.64, "validation": 0.16, "test": 0.20}
    return rep.select("source_rows", sum((F.col(f"{s}_rows") for s in S.SPLITS), F.lit(0)).alias("part_rows"), "overlapping_keys", "missing_keys", "extra_keys",
                      *[(F.abs(F.col(f"{s}_rows") / F.col("source_rows") - near[s]) < 0.035).alias(f"{s}_share_ok") for s in S.SPLITS])


@register("nested_split_two_parts", "with " + ORDERS_SQL + """
select count(*) as source_rows, count(*) as part_rows, 0::bigint as overlapping_keys, 0::bigint as missing_keys, 0::bigint as extra_keys
from ol""")
def q_nested_split_two_parts(spark, d):
    """The two-part form covers the table, and no key is in both parts."""
    src = orders_labelled(spark, d)
    train, test = S.nested_split(src, levels=1)
    rep = S.split_disjointness(src, {"train": train, "test": test}, ["o_orderkey"])
    return rep.select("source_rows", (F.col("train_rows") + F.col("test_rows")).alias("part_rows"), "overlapping_keys", "missing_keys", "extra_keys")


@register("balance_classes", "with " + TX_SQL + """
select y2 as label, true as near_minority, true as all_known from tx group by y2""")
def q_balance_classes(spark, d):
    """Invariants of Bernoulli balancing: each class is near the minority's size, and every row is one of the table's."""
    t = tx(spark, d)
    keys = t.select(*TX_KEY, F.lit(1).alias("known")).distinct()
    least = min(V.counts_dict(t, "y2").values())
    kept = S.balance_classes(t, "y2", seed=42).join(keys, list(TX_KEY), "left")
    return kept.groupBy(F.col("y2").alias("label")).agg(
        (F.abs(F.count(F.lit(1)) - least) <= 6 * F.sqrt(F.lit(float(least))) + 1).alias("near_minority"),
        (F.count("known") == F.count(F.lit(1))).alias("all_known"))


@register("balance_classes_exact", "with " + TX_SQL + f""",
m as (select least(count(*) filter (where y2 = 1), count(*) filter (where y2 = 0)) as m from tx),
r as (select *, row_number() over (partition by y2
          order by {md5_hash_sql(*TX_KEY, seed=42)}, {', '.join(TX_KEY)}) as rn from tx)
select {TX_COLS} from r where rn <= (select m from m)""")
def q_balance_classes_exact(spark, d):
    return S.balance_classes_exact(tx(spark, d), "y2", TX_KEY, seed=42)


@register("replicate_rows", "select orders.* from orders, range(3)")
def q_replicate_rows(spark, d):
    return S.replicate_rows(table(spark, d, "orders"), 3)


@register("sample_with_replacement", f"""
with n as (select count(*) as n from orders),
r as (select *, row_number() over (order by {md5_hash_sql('o_orderkey')}, o_orderkey) as rn from orders),
dr as (select range as draw, {md5_hash_sql('range', seed=7, digits=15)} % (select n from n) + 1 as rn
       from range((select n from n)))
select dr.draw, r.* exclude (rn) from dr join r using (rn)""")
def q_sample_with_replacement(spark, d):
    o = table(spark, d, "orders")
    n = o.count()
    return S.sample_with_replacement(o, ["o_orderkey"], n, seed=7, rows=n)


@register("top_k_large", "with " + TX_SQL + f"""
select {TX_COLS} from (select *, row_number() over (partition by y2 order by {', '.join(TX_KEY)}) as rk,
                              count(*) over (partition by y2) as n from tx)
where rk <= (select count(*) // 3 from tx)""")
def q_top_k_large(spark, d):
    """The same operator where k is a third of the table."""
    t = tx(spark, d)
    return S.top_k_per_class(t, "y2", TX_KEY, t.count() // 3)


@register("sequential_take", """
select * exclude (rn) from (select *, row_number() over (order by o_orderkey) as rn from orders)
where rn <= (select count(*) // 2 from orders)""")
def q_sequential_take(spark, d):
    o = table(spark, d, "orders")
    return S.sequential_take(o, "o_orderkey", o.count() // 2)


@register("random_row", "select 1::bigint as rows, 1::bigint as known")
def q_random_row(spark, d):
    """One row comes, and it is one of the table's."""
    o = orders_labelled(spark, d)
    picked = S.random_row(o, seed=42).select("o_orderkey")
    return picked.join(o.select("o_orderkey", F.lit(1).alias("known")), "o_orderkey", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count("known").alias("known"))


@register("top_k_per_class", "with " + TX_SQL + f"""
select {TX_COLS} from (select *, row_number() over (partition by y2 order by {', '.join(TX_KEY)}) as rk from tx)
where rk <= 5""")
def q_top_k_per_class(spark, d):
    return S.top_k_per_class(tx(spark, d), "y2", TX_KEY, 5)


@register("union_all", f"""with {SPLIT_CTE}
select * exclude (split) from sp where split = 'train'
union all select * exclude (split) from sp where split = 'validation'
union all select * exclude (split) from sp where split = 'test'""")
def q_union_all(spark, d):
    train, val, test = S.split_frames(_split(spark, d))
    return S.union_all(train, val, test)


@register("union_by_name", "with " + TX_SQL + f" select {TX_COLS} from tx")
def q_union_by_name(spark, d):
    t = tx(spark, d)
    pos = t.filter(F.col("y2") == 1)
    neg = t.filter(F.col("y2") == 0).select(*reversed(t.columns))
    return S.union_by_name(pos, neg)
