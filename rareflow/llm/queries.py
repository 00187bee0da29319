"""The operators applied to the standard tables, a query each, and SQL twins where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.llm import byte_bpe, conversations, manifest, mixing, ngram_join, packing, preference, quality_rules, records, revisits, sharding, token_counts, topk
from rareflow.llm.common import crc

BYTE_BPE, BYTE_RANKS, PIECE_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
END_ID = 2
SEQUENCE_TOKENS = 1024
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a Bradley-Terry scorer; labels of held-out documents are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = preference.learn(docs, table(spark, sf_dir, "labels"))
    return preference.scored(docs, ranker).select(
        "doc_id", preference.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= preference.CUT).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the SentencePiece model, long ones spliced from overlapping chunks."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), limit=4096)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by the Jaccard similarity of their sets of five-word shingles, 0.8 or more."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), size=5, similarity=(80, 100))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as framed records and read back through the offset index."""
    folder, index = records.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID)
    return records.read_records(records.dealt_by_bytes(index), folder, with_ids=False)


def crawl(pages: DataFrame) -> DataFrame:
    """Crawl records of the pages table: for each page a full response and three not-modified revisits, one with its (weak)
    entity tag, one with its date only, one before it. Every seventh page has another date by the second revisit."""
    at = (F.col("page_id") * 7919) % 1000003
    tag, day = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), F.expr("((page_id * 7919) % 1000003) div 86400"))
    field = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k.replace("_", "-")), v)])
    date = lambda ts: ts.cast("string")
    soon, late = at + 1000 + F.col("page_id") % 499979, at + 2000000
    kinds = [
        (200, at, field(etag=tag, last_modified=day, cache_control=F.lit("max-age=60"), content_type=F.lit("text/html"),
                        content_length=F.octet_length("html").cast("string"), date=date(at))),
        (304, soon, field(etag=F.concat(F.lit("W/"), tag), cache_control=F.lit("max-age=120"), content_length=F.lit("0"), date=date(soon))),
        (304, late, field(last_modified=F.when(F.col("page_id") % 7 == 0, F.lit("another day")).otherwise(day), date=date(late))),
        (304, at - 1, field(etag=tag, date=date(at - 1))),
    ]
    visits = F.array(*[F.struct((F.col("page_id") * 4 + i).alias("record_id"), F.lit(status).alias("status"), ts.alias("ts"), h.alias("headers"))
                       for i, (status, ts, h) in enumerate(kinds)])
    return pages.select("url", F.explode(visits).alias("v")).select("url", "v.*")


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit of the crawl, with the response it stands for and the merged headers."""
    found = revisits.resolve(crawl(table(spark, sf_dir, "pages")))
    fields = ["etag", "last-modified", "cache-control", "content-type", "content-length", "date"]
    return found.select("record_id", "url_key", "ts", "state", "matched_id", "matched_ts", *[F.col("headers")[f].alias(f.replace("-", "_")) for f in fields])


def op6_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20, against all other vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op7_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes, by fixed virtual slots and an edited map."""
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "v_slot")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens by a plan over the histogram of lengths."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID, SEQUENCE_TOKENS)


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix of the sources by tempered weights, earliest deadline first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, power=0.5, total=1000, block_rows=mixing.BLOCK_ROWS)


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and the verdict of its distance from the language references."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return judged.withColumns({c: F.round(c, 6) for c in ("word_distance", "class_distance")})


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof by descent from the root, and the root that its tampered or original row folds to."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = manifest.rows_of(docs, "source", "doc_id", ("doc_id", "source", "lang", "n_chars", "text"), claimed={"text": tampered})
    built = manifest.build(leaves)
    root = F.lit(built.root and built.root.hex()).cast("string")
    found = manifest.proofs(built, leaves.select("group", "rank", "claimed", "doc_id", "leaf"))
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after its rows were damaged."""
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair(turns, conversations.damage(turns))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the ranks of a byte-level BPE and decoded again, as digests."""
    return byte_bpe.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def _divergence_sql() -> str:
    """SQL twin of op10, with the word lists and thresholds of ``quality_rules``."""
    q = quality_rules
    vocab = q.vocabulary(q.COMMON)
    words = "[" + ", ".join(f"'{w}'" for w in vocab) + "]"
    langs = ", ".join(f"'{k}'" for k in q.COMMON)

    def distance(own: str, ref: str) -> str:
        return f"""sqrt(greatest(list_sum(list_transform(list_zip({own}, {ref}), lambda z:
          (case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0 end) + (case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0 end))) / 2, 0))"""

    def mean(column: str, n: int) -> str:
        return "[" + ", ".join(f"avg({column}[{i}])" for i in range(1, n + 1)) + "]"

    return rf"""
with t as (
  select doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
    regexp_replace(text, '[\p{{Ll}}\x20\x09-\x0D]+', '', 'g') as rest
  from (select doc_id, lang, coalesce(text, '') as text from documents)),
e as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from t where len(w) >= 8)),
r as (
  select doc_id, count(distinct i + k) as n from (
    select doc_id, i, count(*) over (partition by doc_id, g) as many from e), range(8) x(k) where many > 1 group by doc_id),
b as (
  select t.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^{q.SYMBOLS}]+', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({words}, x)) as c
  from t left join r on t.doc_id = r.doc_id),
k as (
  select *, [length(regexp_replace(rest, '[^\p{{Lu}}]+', '', 'g')), length(regexp_replace(rest, '[^\p{{Nd}}]+', '', 'g')),
    length(regexp_replace(rest, '[^.,;:?''"()-]+', '', 'g')), length(regexp_replace(rest, '[^{q.SYMBOLS}]+', '', 'g'))] as cc from b),
h as (
  select *, case when n_words >= {q.MIN_WORDS} then list_concat(list_transform({words}, lambda v: len(list_filter(c, lambda x: x = v)) / n_words::double), [(n_words - len(c)) / n_words::double]) end as wh,
    case when n_words >= {q.MIN_WORDS} then list_transform(list_concat(cc, [length(rest) - list_sum(cc)::bigint, word_chars - length(rest)]), lambda x: x / word_chars::double) end as ch
  from k),
refs as (
  select lang, {mean("wh", len(vocab) + 1)} as wr, {mean("ch", 6)} as cr from h
  where n_words >= {q.MIN_WORDS} and 100 * n_repeat_words <= 30 * n_words and n_words >= 20 and lang in ({langs}) group by lang),
d as (
  select h.doc_id, min({distance("wh", "wr")}) as wd, min({distance("ch", "cr")}) as cd from h, refs where n_words >= {q.MIN_WORDS} group by h.doc_id),
f as (
  select h.*, wd, cd, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    coalesce(wd > {q.MAX_WORD_DISTANCE} + {q.NOISE} / sqrt(n_words) or cd > {q.MAX_CLASS_DISTANCE}, false) as strays
  from h left join d on h.doc_id = d.doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, round(wd, 6) as word_distance, round(cd, 6) as class_distance, base_failed, not base_failed and not strays as kept
from f
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline``, which imports this module."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_preference_quality, op2_token_counts, op3_ngram_join, op4_token_records, op5_revisits, op6_ball_tree_topk,
                            op7_slot_shards, op8_best_fit_packing, op9_pfair_mixing, op10_divergence_rules, op11_merkle_manifest, op12_conversation_repair, op13_byte_bpe, pipeline)
}

ORACLES: dict[str, str] = {
    "op3_ngram_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (
  select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id where 100 * o >= 80 * (x.n + y.n - o)),
reach as (
  select doc_id, doc_id as other from w union select reach.doc_id, link.b from reach join link on reach.other = link.a)
select reach.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other) as component_id
from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id
""",
    "op5_revisits": r"""
with p as (
  select *, (page_id * 7919) % 1000003 as t0, '"' || md5(html) || '"' as tag, 'day ' || (((page_id * 7919) % 1000003) // 86400) as day,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)(?:\?([^#]*))?', ['h', 'p', 'q']) as u from pages),
k as (
  select *, regexp_replace(lower(u.h), '^(www|m)\.', '') || regexp_replace(u.p, '(/index)?(\.html?)?/*$', '') ||
    (case when q <> '' then '?' || q else '' end) as url_key
  from (select *, array_to_string(list_sort(list_filter(string_split(coalesce(u.q, ''), '&'),
    lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') as q from p)),
r as (
  select url_key, t0 as ts, arg_max({id: page_id * 4, tag: tag, day: day, n: strlen(html), t0: t0}, page_id * 4) as m from k group by 1, 2),
v as (
  select page_id * 4 + 1 as record_id, url_key, t0 + 1000 + page_id % 499979 as ts, 'W/' || tag as etag, null as lm, 'max-age=120' as cc, '0' as cl from k
  union all select page_id * 4 + 2, url_key, t0 + 2000000, null, case when page_id % 7 = 0 then 'another day' else day end, null, null from k
  union all select page_id * 4 + 3, url_key, t0 - 1, tag, null, null, null from k),
j as (
  select v.*, r.m, case when r.m is null then 'no_earlier_response'
    when v.etag is not null and replace(v.etag, 'W/', '') = r.m.tag or v.etag is null and v.lm = r.m.day then 'resolved' else 'validator_mismatch' end as state
  from v asof left join r on v.url_key = r.url_key and v.ts > r.ts)
select record_id, url_key, ts, state, case when state = 'resolved' then m.id end as matched_id, case when state = 'resolved' then m.t0 end as matched_ts,
  case when state = 'resolved' then coalesce(etag, m.tag) else etag end as etag, case when state = 'resolved' then coalesce(lm, m.day) else lm end as last_modified,
  case when state = 'resolved' then coalesce(cc, 'max-age=60') else cc end as cache_control, case when state = 'resolved' then 'text/html' end as content_type,
  case when state = 'resolved' then m.n::varchar else cl end as content_length, ts::varchar as date
from j
""",
    "op6_ball_tree_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s) where rank <= 20
""",
    "op10_divergence_rules": _divergence_sql(),
}
