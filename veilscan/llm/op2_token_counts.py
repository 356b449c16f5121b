"""Token counts from an exact histogram of encoded lengths.

Documents are reduced to (length, documents) once; every answer, for any context limit, is a sum over that histogram.
Null and empty texts have length 0; a very long text is encoded whole; repeated rows count as often as they stand; equal
lengths (ties) are one row; an empty table gives an empty histogram, and that no answers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table, written
from .tokens import VOCABULARY, encoded

#: Lengths of one block of suffix sums; sums of blocks are added to sums within a block.
BLOCK = 1024


def token_count(vocabulary: str = VOCABULARY):
    """A column function: the number of ids of a text."""

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(ends) for _, ends in encoded(texts, vocabulary))]))

    return count


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``context_limit`` (a length that occurs) and ``n_docs``. Other columns of ``docs`` are not read."""
    lengths = docs.select(token_count(vocabulary)(docs[text]).alias("context_limit"))
    return lengths.groupBy("context_limit").agg(F.count("*").alias("n_docs"))


def suffix_answers(histogram: DataFrame) -> DataFrame:
    """For each length as a limit: documents that fit and that are longer, tokens left when longer ones are cut at the limit, and the quantile.

    Sums run inside blocks of lengths, and over blocks, so that no task holds the whole histogram."""
    h = histogram.withColumn("block", F.floor(F.col("context_limit") / BLOCK))
    tokens = F.col("context_limit") * F.col("n_docs")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    over = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(over), F.lit(0)).alias("later_docs"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("later_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("context_limit").rowsBetween(1, Window.unboundedFollowing)
    h = h.withColumn("own_docs", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("own_tokens", F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
    longer = F.col("own_docs") + F.col("later_docs")
    kept = F.col("all_tokens") - F.col("own_tokens") - F.col("later_tokens") + longer * F.col("context_limit")
    return h.join(blocks, "block").select(
        "context_limit",
        "n_docs",
        (F.col("all_docs") - longer).alias("docs_fit"),
        longer.alias("docs_longer"),
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_cut"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """The same totals for each stated limit: a nested loop of a few limits against the histogram, not the documents."""
    asked = F.broadcast(limits.select(F.col("limit").cast("long").alias("limit")).distinct())
    n, at, limit = F.col("n_docs"), F.col("context_limit"), F.col("limit")
    return histogram.join(asked, F.lit(True), "right").groupBy("limit").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.when(at > limit, n)), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.least(at, limit) * n), F.lit(0)).alias("tokens_kept"),
    )


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_answers(written(length_histogram(table(spark, sf_dir, "documents"))))
