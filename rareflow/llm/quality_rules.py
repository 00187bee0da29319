"""Quality rules: counts of a text, and how far its character classes and common words stray from its language.

Base rules count words, symbols, repeated lines and repeated windows of words. The divergence rule compares two
histograms of a document, over character classes and over common words, with references, one pair for each language,
by the Jensen-Shannon distance; the nearest language counts. References are the mean histograms of all documents of a
language that pass the base rules and are long enough to have one; short documents, and those in a language without a reference, are not judged by it.
Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflow.llm.common import kept

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Frequent function words of the languages that are judged.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "was", "for", "that", "it", "with", "on", "by", "this"],
    "de": ["der", "die", "und", "in", "den", "das", "zu", "von", "mit", "des", "dem", "ist", "nicht", "ein"],
    "fr": ["de", "la", "le", "les", "et", "des", "un", "une", "du", "en", "que", "est", "pour", "dans"],
    "es": ["de", "la", "el", "que", "y", "en", "los", "las", "un", "una", "del", "se", "por", "no"],
}
#: Histograms of fewer words than this are too rough to compare.
MIN_WORDS = 40
#: Allowed distances; that of common words is widened by NOISE / sqrt(words), about what chance adds.
MAX_WORD_DISTANCE, MAX_CLASS_DISTANCE, NOISE = 0.15, 0.27, 1.1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = [*COUNTS, "word_distance", "class_distance", "base_failed", "kept"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``_words`` to rows with ``_text``."""
    out = docs.withColumn("_words", words_of(F.col("_text")))
    out = out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words, from those of half as many
        out = out.withColumn("_h", F.zip_with("_h", F.slice("_h", step + 1, F.greatest(F.size("_h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    # windows in the order of their hash; those equal to a neighbour occur more than once
    found = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_s", found).drop("_h")
    twice = F.zip_with("_s", F.slice("_s", 2, F.size("_s")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))).drop("_s")
    covered = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    return out.select(
        *[c for c in out.columns if c not in ("_at", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def vocabulary(common: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def measured(docs: DataFrame, columns: list[str], common: dict[str, list[str]], text_col: str, lang_col: str) -> DataFrame:
    """A row for each document, from one reading of its text: ``_row`` (its ``columns``), ``_lang``, the base counts, ``_wc`` (how
    often each common word occurs, last: all other words) and ``_cc`` (characters of each class: upper-case, digits, sentence
    marks, symbols, anything else that is no lower-case letter, lower-case letters). A null text counts as empty."""
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    out = base_counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("_")).alias("_row"), lang.alias("_lang"),
                                  F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text")))
    vocab = vocabulary(common)
    out = out.withColumn("_c", F.filter(F.transform("_words", lambda w: F.lower(w)), lambda w: w.isin(vocab))).drop("_words")
    out = out.withColumn("_rest", F.regexp_replace("_text", r"[\p{Ll}\x20\x09-\x0D]+", "")).drop("_text")
    kinds = [r"[^\p{Lu}]+", r"[^\p{Nd}]+", r"[^.,;:?'\"()\-]+", f"[^{SYMBOLS}]+"]
    out = out.withColumns({f"_k{i}": F.length(F.regexp_replace("_rest", k, "")) for i, k in enumerate(kinds)} | {"_others": F.length("_rest")})
    return out.select(
        "_row", "_lang", *COUNTS,
        # ``_c`` is named more than once, so Spark doesn't move its expression into the lambda, to be computed for each word
        F.concat(F.transform(F.array(*[F.lit(w) for w in vocab]), lambda w: F.size("_c") - F.size(F.array_remove("_c", w))),
                 F.array((F.col("n_words") - F.size("_c")).cast("int"))).alias("_wc"),
        F.array(*[F.col(f"_k{i}") for i in range(4)], F.col("_others") - sum((F.col(f"_k{i}") for i in range(1, 4)), F.col("_k0")),
                (F.col("word_chars") - F.col("_others")).cast("int")).alias("_cc"))


def shares(rows: DataFrame, min_words: int) -> DataFrame:
    """Adds ``_wh`` and ``_ch``, the histograms of ``_wc`` and ``_cc`` as shares, to measured rows; they are null in short texts."""
    long_enough = F.col("n_words") >= max(min_words, 1)
    return rows.withColumns({name: F.when(long_enough, F.transform(counts, lambda x: x / F.col(total).cast("double")))
                             for name, counts, total in (("_wh", "_wc", "n_words"), ("_ch", "_cc", "word_chars"))})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _means(rows: DataFrame, common: dict[str, list[str]], min_words: int) -> dict[str, tuple[list[float], list[float]]]:
    rows = shares(rows.where(F.col("_lang").isin(list(common)) & (F.col("n_words") >= max(min_words, 1)) & ~base_failed()), min_words).select("_lang", "_wh", "_ch")
    sizes = {"_wh": len(vocabulary(common)) + 1, "_ch": 6}
    means = [F.avg(F.col(c)[i]).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    found = rows.groupBy("_lang").agg(*means).collect()
    return {r["_lang"]: tuple([r[f"{c}{i}"] for i in range(n)] for c, n in sizes.items()) for r in found}


def references(docs: DataFrame, common: dict[str, list[str]] = COMMON, min_words: int = MIN_WORDS,
               text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms (common words, character classes) of every language in ``common`` over all its documents of at
    least ``min_words`` words that pass the base rules, so repetitive junk doesn't shift them; a language without any is left out. One small row for each language reaches the driver."""
    return _means(measured(docs, [], common, text_col, lang_col), common, min_words)


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2: 0 to 1) of an array of shares from a reference."""

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    terms = F.zip_with(shares, F.array(*[F.lit(float(x)) for x in reference]), lambda p, q: half(p, q) + half(q, p))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _verdicts(rows: DataFrame, columns: list[str], refs: dict[str, tuple[list[float], list[float]]], min_words: int, max_word: float,
              max_class: float, noise: float) -> DataFrame:
    """Measured rows as ``columns`` of ``_row`` and the columns of a verdict."""
    known = F.coalesce(F.col("_lang").isin(list(refs)), F.col("_lang").isNull())

    def nearest(shares: str, k: int) -> Column:
        far = [distance(F.col(shares), pair[k]) for _, pair in sorted(refs.items())]
        return F.when(F.col("n_words") >= min_words, F.array_min(F.array(*far))) if far else F.lit(None).cast("double")

    rows = shares(rows, min_words).withColumns({"word_distance": nearest("_wh", 0), "class_distance": nearest("_ch", 1)})
    strays = (F.col("word_distance") > max_word + noise / F.sqrt(F.col("n_words"))) | (F.col("class_distance") > max_class)
    rows = rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~(known & F.coalesce(strays, F.lit(False))))
    return rows.select(*[F.col(f"_row.`{c}`") for c in columns], *VERDICT)


def judge(docs: DataFrame, refs: dict[str, tuple[list[float], list[float]]] | None = None, common: dict[str, list[str]] = COMMON,
          min_words: int = MIN_WORDS, max_word: float = MAX_WORD_DISTANCE, max_class: float = MAX_CLASS_DISTANCE,
          noise: float = NOISE, text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (only ``columns``, if they are named) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word_distance, class_distance,
    base_failed and kept (of columns with these names, the new ones remain).

    A null text counts as empty and fails the base rules, as do all texts under 20 words. A text under ``min_words`` words,
    and every text if there are no references, is judged by the base rules alone; its distances are null. A text whose language
    is named but has no reference has distances, which say nothing about its quality, and is judged by the base rules alone too;
    one of unknown language (null, or a table without ``lang_col``) is judged by the nearest reference. Rows are independent of
    each other, and nothing is shuffled. Without ``refs``, the references are those of ``docs``: the measured rows are
    written once, with the columns to return, and both references and verdicts are taken from that table, so a text is read once.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in VERDICT]
    rows = measured(docs, columns, common, text_col, lang_col)
    if refs is None:
        rows = kept(rows, "measured")
        refs = _means(rows, common, min_words)
    return _verdicts(rows, columns, refs, min_words, max_word, max_class, noise)


def filtered(docs: DataFrame, refs: dict[str, tuple[list[float], list[float]]] | None = None, text_col: str = "text", lang_col: str = "lang",
             **rules) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever these are called."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), F.col(f"`{text_col}`").alias("_source"),
                       *([F.col(f"`{lang_col}`").alias("_tongue")] if lang_col in docs.columns else []))
    judged = judge(rows, refs, text_col="_source", lang_col="_tongue", columns=["_own"], **rules).withColumn("_part", F.spark_partition_id())
    # the second condition always holds; without it Spark moves the filter below the projections that make
    # ``kept`` step by step, and writes their expressions into each other over and over
    return judged.where(F.col("kept") & (F.col("_part") >= 0)).select("_own.*")
