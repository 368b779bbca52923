"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer for every context limit.

Documents are encoded, then counted by length: one row for each distinct length, however many documents, and one for each
context limit asked for, whether or not a document has just this length. Suffix sums over that histogram give, for each length as a
context limit, the documents and tokens beyond it, the tokens that remain when longer documents are cut to it, the share of documents
that fit, and the quantiles that the length is.

Null and empty texts have length 0; repeated rows count each; documents of equal length share a row; very long texts are encoded whole; an empty table gives rows of 0 documents for limits only; other columns of
the input are ignored. The histogram is summed before it is shuffled; its windows run over distinct lengths alone, at most
as many as the tokens of the longest text, and are cut into blocks of ``BLOCK`` lengths, so no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import token_lengths
from pulsegrid.llm.shared import written

BLOCK = 256
#: Usual context limits.
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 131072)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and the number of documents with so many."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length: documents and tokens up to it and beyond it, and totals after cutting at it."""
    block = (F.col("n_tokens") / BLOCK).cast("long")
    counts = counts.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select(
        "block",
        F.coalesce(F.sum("d").over(down), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(down), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(Window.partitionBy()).alias("all_docs"),
        F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over_docs = F.col("later_docs") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))
    over_tokens = F.col("later_tokens") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    fit = F.col("all_docs") - F.col("docs_over")
    return (
        counts.join(later, "block")
        .withColumn("docs_over", over_docs)
        .withColumn("tokens_over", over_tokens)
        .select(
            "n_tokens",
            "n_docs",
            "docs_over",
            "tokens_over",
            (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_truncated"),
            "all_docs",
            "all_tokens",
            F.round((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs"), 9).alias("share_fitting"),
            F.array_join(F.filter(F.array(*[F.lit(p) for p in QUANTILES]), lambda p: (fit >= F.col("all_docs") * p) & (fit - F.col("n_docs") < F.col("all_docs") * p)), ",").alias("quantiles"),
        )
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the least length that at least this share of documents does not exceed."""
    picks = [F.min(F.when(F.col("all_docs") - F.col("docs_over") >= F.col("all_docs") * p, F.col("n_tokens"))).alias(f"q{p:g}") for p in shares]
    return sums.agg(*picks)


def token_counts(docs: DataFrame, path: str | None = None, limits: tuple[int, ...] = ()) -> DataFrame:
    """One row for each distinct encoded length and each limit, with suffix sums."""
    counts = written(histogram(token_lengths(docs, path)))
    if limits:
        asked = docs.sparkSession.createDataFrame([(n, 0) for n in limits], "n_tokens long, n_docs long")
        counts = counts.union(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return suffix_sums(counts)
