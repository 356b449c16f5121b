"""Scans' inputs and discovery rows: identifiers, recorded answers, data classes, URL choice, explanations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import hmac_sha256, mask_identifier
from ..sources.scratch import written
from .contain import containing


def query_key(x: Column) -> Column:
    """A query as recorded answers are found by it: no quotes, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, '"', " "), r"\s+", " ")))


def recorded_answers(planned: DataFrame, recorded: DataFrame) -> DataFrame:
    """Planned queries (``query``) with the recorded search (``recorded_id``) that answers each: an equal key, else one that contains the other, the first recorded wins.

    Equal keys are an equi-join. Planned queries without one meet those that they contain, or lie in, by anchors, so parts of
    words count and words that all queries have cost nothing."""
    p = planned.select("query", query_key(F.col("query")).alias("key")).distinct()
    r = recorded.select("recorded_id", query_key(F.col("query")).alias("r_key"))
    equal = p.join(r, p.key == r.r_key).groupBy("query").agg(F.min("recorded_id").alias("recorded_id"))
    rest = written(p.join(equal, "query", "left_anti"))
    first = written(r.filter("r_key <> ''").groupBy("r_key").agg(F.min("recorded_id").alias("recorded_id")))
    pairs = containing(rest, first, "key", "r_key").unionByName(containing(first, rest, "r_key", "key")).distinct()
    near = rest.join(pairs, "key").join(first, "r_key").groupBy("query").agg(F.min("recorded_id").alias("recorded_id"))
    return equal.unionByName(near)


def first_identifiers(identifiers: DataFrame) -> DataFrame:
    """One row for each identity: its first identifier of each type, as columns."""
    pick = lambda kind: F.min_by("value", F.when(F.col("type") == kind, F.col("seq")))
    return identifiers.groupBy("identity_id").agg(*[F.when(F.count_if(F.col("type") == k) > 0, pick(k)).alias(k.lower()) for k in ("EMAIL", "PHONE", "USERNAME", "NAME")])


def public_identifiers(identifiers: DataFrame, key: bytes) -> DataFrame:
    """What may be shown of identifiers: masked values and their keyed hash, no raw value."""
    return identifiers.select("identity_id", "type", mask_identifier(F.col("type"), F.col("value")).alias("masked"), hmac_sha256(key, F.col("value")).alias("value_key"))


def without_identifiers(identifiers: DataFrame, deleted: DataFrame, consents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identifiers and consents after some identifiers (``identifier_id``) are deleted."""
    gone = deleted.select("identifier_id").distinct()
    return identifiers.join(gone, "identifier_id", "left_anti"), consents.join(gone, "identifier_id", "left_anti")


def data_classes(passwords: Column, kind: Column) -> Column:
    """What a breach exposes, by its flags."""
    return F.array_compact(F.array(F.lit("Email addresses"), F.when(passwords | (kind == "CREDENTIAL_EXPOSURE"), "Passwords"), F.when(kind == "API_KEY_EXPOSURE", "API keys")))


def chosen_urls(results: DataFrame, n: int = 10) -> DataFrame:
    """The n best results of a scan: the identifier in the text, then in the URL, the source's rank, how many queries agree, the content type."""
    order = [F.desc(F.col("in_text").cast("int")), F.desc(F.col("in_url").cast("int")), "source_rank", F.desc("agreement"), F.desc((F.col("content_type") == "html").cast("int")), "url"]
    w = Window.partitionBy("scan_id").orderBy(*order)
    return results.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def explained(findings: DataFrame, explanations: DataFrame) -> DataFrame:
    """Findings with new explanations by (identity, source, entity); the old one stays where there is none. Of several for a key the smallest text is taken."""
    keys = ["identity", "source", "entity"]
    new = explanations.groupBy(*keys).agg(F.min("summary").alias("__new"))
    return findings.join(new, keys, "left").withColumn("summary", F.coalesce("__new", "summary")).drop("__new")
