"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated word windows. The verdict of
the others is a hashed n-gram log-likelihood ratio: words and word pairs are hashed to a
fixed number of buckets; one multinomial is counted over trusted rows, one over all rows;
a document's score is the mean over its n-grams of the log ratio of the two. Documents
below a fixed threshold are rejected; nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, texts_of

#: What each bucket's share is raised by in both multinomials.
SMOOTHING = 2e-6
#: Symbols that the base rules count.
SYMBOLS = r"[#*$%&|<>]"


def _words(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``doc_id, text, words``, and ``row`` with all columns of ``docs`` if asked for."""
    split = F.array_remove(F.split("text", WORD_SPLIT), "")
    if not carry:
        return texts_of(docs, id_col, text_col).withColumn("words", split)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    return docs.select(row, F.col(f"`{id_col}`").cast("long").alias("doc_id"), text).withColumn("words", split)


def _grams(buckets: int):
    """Bucket numbers of all words, then of all pairs (the last word with none)."""
    one = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform("words", lambda w, i: F.pmod(F.xxhash64(w, F.get("words", i + 1), F.lit(2)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def base_counts(words: DataFrame, window: int = 8) -> DataFrame:
    """Adds the counts of the base rules to ``doc_id, text, words``."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.when(
        F.size("words") > window,
        F.transform(F.sequence(F.lit(1), F.size("words") - (window - 1)), lambda i: F.xxhash64(F.slice("words", i, window))),
    )
    counted = words.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        hashes.alias("hashes"),
    )
    # only texts with a repeated window are looked at further
    ordered = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    sorted_ = counted.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), ordered.alias("ordered"))
    same = lambda x, k: F.coalesce(F.get("ordered", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("ordered", k + 1)["h"] == x["h"], F.lit(False))
    found = F.array_sort(F.transform(F.filter("ordered", same), lambda x: x["i"]))
    placed = sorted_.withColumn("found", found)
    steps = F.transform("found", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("found", k + 1) - p, F.lit(window))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, s: a + s), F.lit(0)).cast("long")
    return placed.withColumn("n_repeat_words", repeated).drop("lines", "hashes", "ordered", "found", "text")


def ratio_weights(words: DataFrame, trusted: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """One row: the log ratio of each bucket, in order, as one array of fixed length.

    Both multinomials are mixed with the same part of a constant for each bucket, so the
    ratios depend on shares alone: a corpus repeated many times keeps its verdicts."""
    marked = words.join(F.broadcast(trusted.select("doc_id").distinct().withColumn("good", F.lit(1))), "doc_id", "left")
    grams = marked.select("good", F.explode(_grams(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    every = words.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    listed = filled.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = F.transform("c", lambda x: F.log((x["target"] / F.col("n_target") + smoothing) / (x["raw"] / F.col("n_raw") + smoothing)))
    return listed.select(F.when(F.col("n_target") > 0, ratio).alias("weights"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = -0.1,
    buckets: int = 16384,
    smoothing: float = SMOOTHING,
    trusted_rows: int = 20_000,
    least_words: int = 20,
    repeat_percent: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts, base verdict, ratio score and verdict of every row of ``docs``.

    ``trusted`` holds doc_ids of good documents. At most ``trusted_rows`` of them, those
    with the least hashes, are the target; the raw multinomial is counted over all rows.
    Without any trusted row the ratio is null and only base rules decide. A null or empty
    text has no words and fails the base rules. Rows with equal ids are judged each by
    itself; other columns are ignored; an empty table gives no rows. Filter by the verdict
    with ``good_rows``, or on a written table: pushed into this plan, such a filter copies
    the long expressions many times over.
    """
    return _judged(_words(docs, id_col, text_col), trusted, threshold, buckets, smoothing, trusted_rows, least_words, repeat_percent)


def good_rows(docs: DataFrame, trusted: DataFrame, threshold: float = -0.1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, that ``quality_rules`` keeps."""
    rules = {"buckets": 16384, "smoothing": SMOOTHING, "trusted_rows": 20_000, "least_words": 20, "repeat_percent": 30} | options
    judged = _judged(_words(docs, id_col, text_col, carry=True), trusted, threshold, **rules)
    # the row number keeps the optimiser from copying the verdict's long expressions into the scan's filter
    held = judged.withColumn("turn", F.monotonically_increasing_id()).where("kept AND turn >= 0")
    return held.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _judged(words, trusted, threshold, buckets, smoothing, trusted_rows, least_words, repeat_percent):
    good = trusted.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
    weights = ratio_weights(words.select("doc_id", "words"), good, buckets, smoothing).scalar()
    scored = base_counts(words).withColumn("weights", weights)
    total = F.aggregate(_grams(buckets), F.lit(0.0), lambda a, b: a + F.get("weights", b))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = scored.select(
        *[c for c in words.columns if c == "row"], "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(F.col("n_words") > 0, total / (2 * F.col("n_words"))).alias("ratio"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("ratio") >= threshold, F.lit(True)))
