"""Evaluation: the golden classifier over corpus entries, counts by person, precision and recall."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(x: Column) -> Column:
    return F.replace(F.trim(F.lower(F.coalesce(x, F.lit("")))), F.lit(" "), F.lit(""))


def classified(entries: DataFrame, people: DataFrame) -> DataFrame:
    """Corpus entries with the class that the golden rules give: an identifier confirms; a name needs two more signals; a name alone is never more than no match."""
    both = entries.alias("e").join(people.alias("p"), "person_id")
    same = lambda c: (F.coalesce(F.col(f"e.{c}"), F.lit("")) != "") & (_key(F.col(f"e.{c}")) == _key(F.col(f"p.{c}")))
    only = lambda x: F.regexp_replace(x, r"\D", "")
    phone = (F.coalesce(F.col("e.phone"), F.lit("")) != "") & (only(F.col("e.phone")) == only(F.coalesce(F.col("p.phone"), F.lit(""))))
    strong = same("email") | phone | same("username")
    count = sum((F.col(f"e.{c}").isNotNull() & F.col(f"p.{c}").isNotNull() & (_key(F.col(f"e.{c}")) == _key(F.col(f"p.{c}")))).cast("int") for c in ("organization", "location", "city", "state"))
    label = F.when(strong, "CONFIRMED").when(same("name") & (count >= 2), "POTENTIAL").otherwise("NO_MATCH")
    return both.select("entry_id", "person_id", label.alias("classification"), count.alias("signals"))


def by_person(rows: DataFrame) -> DataFrame:
    """Classes by person, and over all (person null)."""
    counts = [F.count_if(F.col("classification") == c).alias(n) for c, n in (("CONFIRMED", "confirmed"), ("POTENTIAL", "potential"), ("NO_MATCH", "no_match"))]
    return rows.rollup("person_id").agg(F.count("*").alias("entries"), *counts)


def decoys(rows: DataFrame, *by: str) -> DataFrame:
    """False positives among entries that match no one, over all or for each set."""
    n = F.count_if(F.col("classification") != "NO_MATCH")
    return rows.groupBy(*by).agg(F.count("*").alias("decoys"), n.alias("false_positives"), F.when(n == 0, "PASS").otherwise("FAIL").alias("verdict"))


def mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Entries whose classes differ, or that one side lacks."""
    both = expected.withColumnRenamed("classification", "expected").join(actual.select("entry_id", F.col("classification").alias("actual")), "entry_id", "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).select("entry_id", "expected", "actual")


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str], by: str) -> DataFrame:
    """True and false positives and negatives by type, with precision, recall and F1."""
    f = found.select(by, *keys).distinct().withColumn("f", F.lit(1))
    t = truth.select(by, *keys).distinct().withColumn("t", F.lit(1))
    both = f.join(t, [by, *keys], "full_outer").groupBy(by).agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return both.select(by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
