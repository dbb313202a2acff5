"""Quality rules in DataFrame functions only: counts of every whole text, and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed unigrams and bigrams of lower-case tokens
(runs of letters and digits, runs of other signs): the trusted target, counted over all
documents labelled good, and the raw corpus, counted over all documents.  A document's score is the sum of log(target / raw) over
its n-grams, divided by their number.  A document is kept if no base rule fails and its
score reaches the threshold, which is a quantile of the trusted documents' own scores, lowered
halfway to the median of those labelled bad where that lies below it.

Null and empty texts have no words, score 0 and fail the base rules.  Repeated rows are
scored alike, row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.quantiles import exact_quantiles
from tillsight.llm._tables import written

BUCKETS = 1 << 15      # hashed n-grams
SMOOTH = 0.5           # added to every bucket's count
KEEP_QUANTILE = 0.002  # part of the trusted documents allowed below the threshold
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANK = "[\\x20\\x09-\\x0D]+"
TOKEN = "[0-9a-z\\x{80}-\\x{10FFFF}]+|[^0-9a-z\\x20\\x09-\\x0D\\x{80}-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _positions(n: Column) -> Column:
    """0 to n - 1, none for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _with_repeat_words(held: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words covered by windows whose hash (``_grams``) occurs twice or more.

    O(n log n): windows sorted by hash, those equal to a neighbour, their starts in order.  Every
    array that a lambda looks into is a column of its own, so that it is made once per row.
    """
    pairs = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    held = held.withColumn("_pairs", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs))

    def same(i: Column, j: Column) -> Column:
        return F.coalesce(F.get("_pairs", i)["g"] == F.get("_pairs", j)["g"], F.lit(False))

    twice = F.filter("_pairs", lambda p, i: same(i, i - 1) | same(i, i + 1))
    held = held.withColumn("_starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    covered = F.transform("_starts", lambda s, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - s, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    return held.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint")))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.withColumn("_words", F.transform(words(body), lambda w: F.xxhash64(w)))
    n = F.size("_words")
    # a window is the hash of its words' hashes: each word's characters are read once
    gram = F.transform(_positions(n - (WINDOW - 1)),
                       lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(WINDOW)]))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\r\x0b\x0c", "")) > 0)
    held = held.select("*", gram.alias("_grams"), lines.alias("_lines"))
    out = _with_repeat_words(held).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.cast("bigint").alias("n_words"),
        F.length(F.translate(body, " \t\n\r\x0b\x0c", "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def with_ngrams(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_ngrams``: the buckets of all unigrams and bigrams of a text, from one hash per token."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    held = docs.withColumn("_hashes", F.transform(found, lambda t: F.hash(t)))
    pairs = F.transform(_positions(F.size("_hashes") - 1),
                        lambda i: F.pmod(F.hash(F.get("_hashes", i), F.get("_hashes", i + 1)), F.lit(BUCKETS)))
    return held.withColumn("_ngrams", F.concat(
        F.transform("_hashes", lambda h: F.pmod(h, F.lit(BUCKETS))), pairs)).drop("_hashes")


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Every labelled id once, with its class (``good``: 1 if any of its labels is)."""
    return labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("good"))


def log_ratios(docs: DataFrame, known: DataFrame, key: str, text: str) -> list[float]:
    """log(target / raw) of each of the ``BUCKETS`` buckets; raw counts cover every document, target counts every one
    that ``known`` has as good."""
    # a hash join of shuffled rows: labels grow with the documents, and texts aren't sorted
    flagged = docs.join(known.where("good = 1").select(key, F.lit(1).alias("_t")).hint("shuffle_hash"), key, "left")
    # outer: an inner explode would first filter on the array's size, and make the array twice
    counts = (with_ngrams(flagged, text)
              .select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode_outer("_ngrams").alias("b"))
              .where("b is not null").groupBy("b")
              .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")))
    # at most BUCKETS rows reach the driver, whatever the input
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + SMOOTH * BUCKETS, sum(target) + SMOOTH * BUCKETS
    return [math.log((t + SMOOTH) / n_target) - math.log((r + SMOOTH) / n_raw) for t, r in zip(target, raw)]


def score(docs: DataFrame, weights: list[float], text: str) -> DataFrame:
    """Add ``llr``, the mean log ratio of a text's n-grams (0 without any)."""
    held = with_ngrams(docs, text)
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate("_ngrams", F.lit(0.0), lambda acc, b: acc + F.get(w, b))
    return held.select(*[F.col(f"`{c}`") for c in docs.columns],
                       F.when(F.size("_ngrams") > 0, total / F.size("_ngrams")).otherwise(F.lit(0.0)).alias("llr"))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  label: str = "quality") -> DataFrame:
    """Base counts, ``llr`` and ``kept`` for every row of ``docs`` (columns ``key`` and ``text`` are read).

    Without labelled documents the score is 0 everywhere and only the base rules decide.
    """
    docs = docs.select(key, text)
    known = written(labelled(labels, key, label), "rules-labels")
    weights = log_ratios(docs, known, key, text)
    # written: the threshold reads the scores that are returned
    scored = written(score(base_counts(docs, text), weights, text).drop(text), "rules-scored")
    marked = scored.select(key, "llr").join(known, key)
    at = {r["good"]: r for r in exact_quantiles(marked, ["good"], "llr", [KEEP_QUANTILE, 0.5]).collect()}
    good, bad = at[1]["q0"] if 1 in at else None, at[0]["q1"] if 0 in at else None
    if good is None:
        threshold = float("-inf")
    elif bad is not None and bad < good:
        threshold = (good + bad) / 2
    else:
        threshold = good
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
