"""Queries over customers, orders and pages as identifiers, recorded searches and findings."""

from pyspark.sql import functions as F

from ..operators import discovery as D
from .registry import query, table


@query("""WITH p AS (SELECT DISTINCT c_mktsegment || ' ' || (c_custkey % 50) AS q FROM customer), r AS (SELECT o_orderkey AS id, ['automobile 7', 'building', 'machinery 3 plus', 'household 8'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS k FROM orders),
k AS (SELECT k, min(id) AS id FROM r GROUP BY k), e AS (SELECT q, min(id) AS id FROM p JOIN k ON lower(q) = k GROUP BY q),
n AS (SELECT q, min(id) AS id FROM p JOIN k ON contains(lower(q), k) OR contains(k, lower(q)) WHERE q NOT IN (SELECT q FROM e) GROUP BY q)
SELECT '"' || q || '"' AS query, id AS recorded_id FROM (SELECT * FROM e UNION ALL SELECT * FROM n)""")
def recorded_query_match(spark, sf_dir):
    planned = table(spark, sf_dir, "customer").select(F.expr("""concat('"', c_mktsegment, ' ', c_custkey % 50, '"')""").alias("query"))
    recorded = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recorded_id"), F.get(F.array(*[F.lit(x) for x in ('automobile "7"', "Building", "machinery  3 plus", "HOUSEHOLD 8")]), (F.col("o_orderkey") % 4).cast("int")).alias("query"))
    first = recorded.groupBy("query").agg(F.min("recorded_id").alias("recorded_id"))  # equal searches: the first
    return D.recorded_answers(planned, first)


def identifiers(spark, sf_dir):
    """Orders as identifiers of customers: the type by the key's remainder."""
    o = table(spark, sf_dir, "orders")
    kind = F.get(F.array(F.lit("EMAIL"), F.lit("PHONE"), F.lit("USERNAME")), (F.col("o_orderkey") % 3).cast("int"))
    value = F.when(kind == "EMAIL", F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("@x.in"))).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 9, "7"))
    return o.select(F.col("o_orderkey").alias("identifier_id"), F.col("o_custkey").alias("identity_id"), kind.alias("type"), value.alias("value"), F.col("o_orderkey").alias("seq"))


_VALUE = "CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_orderkey || '@x.in' ELSE lpad(CAST(o_orderkey AS VARCHAR), 9, '7') END"


@query(f"SELECT o_custkey AS identity_id, arg_min({_VALUE}, o_orderkey) FILTER (o_orderkey % 3 = 0) AS email, arg_min({_VALUE}, o_orderkey) FILTER (o_orderkey % 3 = 1) AS phone, arg_min({_VALUE}, o_orderkey) FILTER (o_orderkey % 3 = 2) AS username FROM orders GROUP BY 1")
def first_identifiers(spark, sf_dir):
    return D.first_identifiers(identifiers(spark, sf_dir)).drop("name")


@query("""SELECT o_custkey AS identity_id, CASE o_orderkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' ELSE 'USERNAME' END AS type,
CASE o_orderkey % 3 WHEN 0 THEN 'a***@x.in' WHEN 1 THEN '+' || left(lpad(CAST(o_orderkey AS VARCHAR), 9, '7'), 2) || ' •••• ' || right(lpad(CAST(o_orderkey AS VARCHAR), 9, '7'), 4) ELSE left(lpad(CAST(o_orderkey AS VARCHAR), 9, '7'), 1) || '••••' || right(lpad(CAST(o_orderkey AS VARCHAR), 9, '7'), 2) END AS masked FROM orders""")
def public_identifiers(spark, sf_dir):
    return D.public_identifiers(identifiers(spark, sf_dir), b"key").drop("value_key")


@query("""SELECT o_orderkey AS identifier_id, count(*) AS consents FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 0 GROUP BY 1""")
def identifier_deletion(spark, sf_dir):
    """Consents (line items) that are left of identifiers (orders) after those of some customers are deleted."""
    i = identifiers(spark, sf_dir)
    consents = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("identifier_id"), "l_linenumber")
    left, kept = D.without_identifiers(i, i.filter("identity_id % 10 = 0"), consents)
    return kept.join(left.select("identifier_id"), "identifier_id").groupBy("identifier_id").agg(F.count("*").alias("consents"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'Email addresses,Passwords' WHEN o_orderkey % 4 = 1 THEN 'Email addresses,API keys' ELSE 'Email addresses' END || CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 1 THEN ',API keys' ELSE '' END AS classes FROM orders")
def breach_data_classes(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "CREDENTIAL_EXPOSURE").when(k % 4 == 1, "API_KEY_EXPOSURE").otherwise("OTHER")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(D.data_classes(k % 3 == 0, kind), ",").alias("classes"))


@query("""WITH r AS (SELECT page_id % 7 AS scan_id, url, page_id, contains(html, 'the') AS in_text, contains(url, '/en') AS in_url, page_id % 3 AS source_rank, page_id % 2 AS agreement FROM pages)
SELECT scan_id, page_id, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY CAST(in_text AS INTEGER) DESC, CAST(in_url AS INTEGER) DESC, source_rank, agreement DESC, url, page_id) AS n FROM r) WHERE n <= 10""")
def url_selection(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    r = p.select((F.col("page_id") % 7).alias("scan_id"), "page_id", F.concat("url", F.lit(" "), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("url"), F.contains("html", F.lit("the")).alias("in_text"), F.contains("url", F.lit("/en")).alias("in_url"), (F.col("page_id") % 3).alias("source_rank"), (F.col("page_id") % 2).alias("agreement"), F.lit("html").alias("content_type"))
    return D.chosen_urls(r).select("scan_id", "page_id", "place")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'old' END AS summary FROM orders")
def explanation_backjoin(spark, sf_dir):
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("identity"), F.lit("s").alias("source"), k.cast("string").alias("entity"), F.when(k % 3 < 2, "old").alias("summary"))
    e = f.filter("id % 3 = 0").select("identity", "source", "entity", F.concat(F.lit("new "), "entity").alias("summary"))
    return D.explained(f, e).select("id", "summary")
