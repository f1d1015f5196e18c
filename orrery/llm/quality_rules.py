"""Quality rules: counts of words, symbols and repeats, and a log-likelihood ratio of hashed n-grams.

Everything is a DataFrame expression: each document's words, hashes and counts stay in its own row. Shuffled are the
table of n-gram counts (one row for each of `buckets` values, at most) and, where there are more than BROADCAST_IDS
trusted ids, the texts, once, to be joined to them; up to that number, which is counted first, the ids are broadcast.

The method: words and pairs of words are hashed into `buckets` values. A multinomial of the trusted texts and one of
all texts give each value its log-likelihood ratio; a document's score is the mean over its n-grams. A document is
kept if the basic rules hold and the score is at least `threshold`.

Cases: a null or blank text has no words and fails the rules. Without trusted texts every score is 0, and the basic
rules decide. Repeated rows, null ids and further columns of any name pass through; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Values that n-grams are hashed to.
BUCKETS = 1 << 16
#: Mean log-likelihood ratio that a kept document has at least.
THRESHOLD = -0.1
#: Added to each count of the trusted multinomial; each count of the other one gets as much for its size, so that a
#: value seen once or twice says little in a corpus of any size.
SMOOTHING = 8.0
#: Trusted ids that are broadcast at most, if they are numbers (8 bytes each); others and more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def windows_of(hashes: Column) -> Column:
    """A hash for each 3-word window. hashes: one for each word."""
    return F.when(F.size(hashes) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    )


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all of the document's columns), hashes of its words, and the counts of the basic rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.struct("*").alias("row"), text.alias("text"), words_of(F.col(text_col)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "row",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    out = out.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows_of(F.col("hashes")).alias("windows")).drop("lines")
    in_order = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("ordered", in_order).drop("windows")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    repeats = F.filter("ordered", lambda x, k: same(x, F.get("ordered", k - 1)) | same(x, F.get("ordered", k + 1)))
    out = out.withColumn("starts", F.sort_array(F.transform(repeats, lambda x: x["i"]))).drop("ordered")
    new = F.transform("starts", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("starts", k - 1), p - 3)))
    return out.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)).drop("starts")


def n_grams(hashes: Column, buckets: int) -> Column:
    """The values of a document's words and pairs of words."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    twos = F.transform(hashes, lambda h, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(hashes, i - 1), h), F.lit(buckets)).cast("int")))
    return F.concat(ones, F.slice(twos, 2, F.greatest(F.size(hashes) - 1, F.lit(0))))


def log_ratios(grams: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """One row: ratios, an array by value. grams: columns gram and trusted (boolean), a row for each n-gram of the corpus."""
    counts = grams.groupBy("gram").agg(F.count("*").alias("raw"), F.sum(F.col("trusted").cast("long")).alias("good"))
    every = grams.sparkSession.range(buckets).select(F.col("id").cast("int").alias("gram"))
    counts = every.join(counts, "gram", "left").na.fill(0, ["raw", "good"])
    row = counts.agg(F.sort_array(F.collect_list(F.struct("gram", "raw", "good"))).alias("all"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    ratio = lambda x: F.when(F.col("n_good") == 0, F.lit(0.0)).otherwise(
        F.log((x["good"] + smoothing) / (x["raw"] * (F.col("n_good") / F.col("n_raw")) + smoothing))
    )
    return row.select(F.transform("all", ratio).alias("ratios"))


def judged(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """row (the document's columns as a struct), the counts, base_failed, score and kept, a row for each document.

    trusted_ids: ids (column of the name id_col) of documents of the trusted target, however many.
    """
    chosen = trusted_ids.select(F.col(id_col).alias("trusted_id")).dropna().distinct()
    if dict(chosen.dtypes)["trusted_id"] in ("tinyint", "smallint", "int", "bigint") and chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    # the texts, which are smaller than their hashes, as Spark may choose to shuffle them
    marked = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("said")).join(chosen, F.col("of") == F.col("trusted_id"), "left")
    hashed = marked.select(F.col("trusted_id").isNotNull().alias("trusted"), F.transform(words_of(F.col("said")), lambda w: F.xxhash64(w)).alias("hashes"))
    grams = hashed.select("trusted", F.explode(n_grams(F.col("hashes"), buckets)).alias("gram"))
    ratios = log_ratios(grams, buckets, smoothing).scalar()
    counted = with_counts(docs, text_col).withColumn("grams", n_grams(F.col("hashes"), buckets)).drop("hashes")
    # grams is used twice here, so the optimizer keeps it apart and moves the ratios into the sum: no row carries a copy of them
    counted = counted.select("*", F.size("grams").alias("n_grams"), ratios.alias("ratios"))
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get("ratios", g))
    scored = counted.withColumn("score", F.when(F.col("n_grams") > 0, total / F.col("n_grams")).otherwise(0.0)).drop("grams", "n_grams", "ratios")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def kept_documents(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The documents that judged() keeps, with the columns they came with."""
    # not a filter: that would be pushed down through, and copy, all the expressions above
    return judged(docs, trusted_ids, id_col, text_col, **how).select(F.inline(F.when(F.col("kept"), F.array("row"))))
