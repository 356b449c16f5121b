"""A corpus pipeline: language, toxicity, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next one's
documents. The first four keep the columns of documents, whatever other columns there are, and drop rows; the last gives
the pieces of packed sequences. An empty table stays empty in every stage, and texts of any length are read whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import op1_language_id, op3_decontamination, op4_toxicity, op5_packing, op10_near_duplicates
from veilscan.llm.common import fresh, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too) go: no language can be told of them. Every text with one has a
    predicted language and stays, whatever its score, also where no language could be learned. Repeated rows go or stay alike."""
    mark = fresh(docs, "__language")
    named = op1_language_id.with_language(docs, table(spark, sf_dir, "documents"), into=mark)
    return named.filter(F.col(f"{mark}.lettered")).drop(mark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are likelier toxic than not go; a score of exactly one half is toxic. Null and empty texts have the score
    of labels' shares. Equal texts go or stay alike."""
    mark = fresh(docs, "__toxicity")
    scored = op4_toxicity.with_toxicity(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), into=mark)
    return scored.filter(F.col(mark) < 0.5).drop(mark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays: that of the smallest doc_id, null last; of rows that tie, that of
    the smallest hash. Null, empty and wordless texts have no duplicates and stay."""
    return op10_near_duplicates.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Repeated rows go or stay alike."""
    return op3_decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences. A null or empty text is its end id alone; each row is packed once, ties in
    length in order of doc_id."""
    return op5_packing.pack(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn models and count ids of a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
