"""Queries over answers, catalogs and corpora in JSON of many shapes; keys decide which spellings a row has."""

from pyspark.sql import functions as F

from ..sources import records
from .registry import query, table


def _case(key, *values):
    """The value at key modulo their number; None is null."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(key % len(values) == i, v).otherwise(out)
    return out


def _object(*fields):
    """A JSON object as text, of (key, JSON text) pairs whose text isn't null."""
    name = lambda k: F.concat(F.lit('"'), F.lit(k) if isinstance(k, str) else k, F.lit('":'))
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(name(k), v) for k, v in fields]), F.lit("}"))


def _quoted(value):
    return F.concat(F.lit('"'), value, F.lit('"'))


def _list(column):
    return F.concat(F.lit("["), F.array_join(column, ","), F.lit("]"))


@query("""WITH o AS (SELECT 'u' || o_custkey AS email, o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
d AS (SELECT *, CASE WHEN k % 8 = 0 THEN 'Emails' ELSE CASE k % 4 WHEN 0 THEN 'Emails, Passwords' WHEN 1 THEN 'Hashed passwords' WHEN 2 THEN 'Phones' END END AS classes FROM o)
SELECT email, 'B' || k AS name, 'Breach record: B' || k AS title, CAST(total AS INTEGER) AS total, CASE WHEN k % 8 = 0 THEN NULL WHEN k % 4 < 3 THEN day END AS date,
CASE WHEN k % 4 = 3 THEN c % 2 = 0 ELSE contains(lower(classes), 'passw') END AS credential,
'Email address appears in the "B' || k || '" breach record.' || coalesce(' Exposed data: ' || classes || '.', '') AS snippet, CASE WHEN c % 3 = 0 THEN 'High' END AS risk_label, CASE WHEN k % 4 = 2 THEN '{"pages":' || k || '}' END AS other
FROM d WHERE n <= 25""")
def breach_discoveries(spark, sf_dir):
    """Orders as breaches of customers, told in every spelling: names in nested lists, details of three of four, some of them told again."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name, day = _quoted(F.concat(F.lit("b"), k.cast("string"))), _quoted(F.date_format("o_orderdate", "yyyy-MM-dd"))
    first = _object(("name", name), ("xposed_date", day), ("xposed_data", F.lit('["Emails","Passwords",7]')))
    second = _object(("Breach", name), ("breach_date", day), ("XPOSED_DATA", F.lit("[]")), ("data_classes", F.lit('["Hashed passwords"]')))
    third = _object(("title", name), ("date", day), ("dataClasses", F.lit('["Phones"," "]')), ("pages", k.cast("string")))
    again = _object(("name", name), ("xposed_data", F.lit('["Emails"]')))
    told = F.struct(k.alias("k"), F.concat(F.lit('"B'), k.cast("string"), F.lit('"')).alias("name"), F.concat_ws(",", _case(k, first, second, third, None), F.when(k % 8 == 0, again)).alias("detail"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(told)).alias("bs"))
    c = F.col("o_custkey")
    email = F.concat(F.lit("u"), c.cast("string")).alias("email")
    listed = _list(F.transform("bs", lambda b: F.when(c % 2 == 0, b["name"]).otherwise(F.concat(F.lit("["), b["name"], F.lit(',"",3]')))))
    details = _list(F.filter(F.transform("bs", lambda b: b["detail"]), lambda d: d != ""))
    strength = F.when(c % 2 == 0, F.lit('{"EasyToCrack":2}')).otherwise(F.lit('{"PlainText":0,"StrongHash":4}'))
    inner = _object(("get_details", details), ("passwords_strength", strength), ("risk", F.when(c % 3 == 0, F.lit('[{"risk_label":"High"}]'))))
    names = g.select(email, _object(("breaches", listed)).alias("json"))
    metrics = g.select(email, F.when(c % 2 == 0, _object(("BreachMetrics", inner))).otherwise(_object(("breach_metrics", inner))).alias("json"))
    return records.breach_rows(records.breach_names(names), records.breach_details(metrics))


@query("""WITH p AS (SELECT page_id, url, page_id // 10 AS g, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS n FROM pages)
SELECT CASE WHEN g % 2 = 0 THEN 'p' || g END AS person_id, CASE WHEN g % 2 = 0 THEN 'q' END AS query, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id ELSE url END AS title, url, CASE WHEN page_id % 3 = 1 THEN 's' || page_id ELSE '' END AS snippet,
CASE WHEN page_id % 3 = 2 THEN 100 + page_id ELSE n END AS position, CASE WHEN page_id % 3 = 2 THEN '{"confidence":0.5,"evidence_tier":"snippet"}' END AS other FROM p WHERE page_id % 7 > 0""")
def search_shapes(spark, sf_dir):
    """Pages as search answers of ten, every second one live, the others recorded; some results lack their link."""
    p = F.col("page_id")
    text = p.cast("string")
    link = F.when(p % 7 == 0, F.lit('""')).otherwise(F.to_json(F.struct("url")).substr(F.lit(8), F.length(F.to_json(F.struct("url"))) - 8))
    more = [("title", F.when(p % 3 == 0, _quoted(F.concat(F.lit("T"), text)))), ("snippet", F.when(p % 3 == 1, _quoted(F.concat(F.lit("s"), text)))), ("position", F.when(p % 3 == 2, (p + 100).cast("string")))]
    more += [("evidence_tier", F.when(p % 3 == 2, F.lit('"snippet"'))), ("confidence", F.when(p % 3 == 2, F.lit("0.5")))]
    rows = table(spark, sf_dir, "pages").withColumn("g", F.floor(p / 10))
    live = F.col("g") % 2 == 1
    told = F.struct("page_id", F.when(live, _object(("link", link), *more)).otherwise(_object(("url", link), *more)).alias("r"))
    a = rows.groupBy("g").agg(F.array_sort(F.collect_list(told)).alias("rs"))
    results = _list(F.transform("rs", lambda x: x["r"]))
    recorded = _object(("searches", F.concat(F.lit("["), _object(("person_id", _quoted(F.concat(F.lit("p"), F.col("g").cast("string")))), ("query", F.lit('"q"')), ("results", results)), F.lit("]"))))
    got = records.search_rows(a.select(F.when(live, _object(("organic", results))).otherwise(recorded).alias("json")))
    return got.drop("content_type").withColumn("position", F.col("position").cast("long"))


@query("""SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey || '@a.in' END AS email, CASE WHEN c_custkey % 3 = 2 THEN '{"segment":"' || c_mktsegment || '","tags":[' || c_custkey || ']}' END AS other FROM customer""")
def corpus_entries(spark, sf_dir):
    """Customers as sparse entries of a corpus, written to a shared folder and read back, in two spellings of the name."""
    from ..sources.scratch import new_path

    where, k = new_path(spark, "corpus"), F.col("c_custkey")
    name = _quoted(F.col("c_name"))
    ident = _quoted(F.concat(F.lit("c"), k.cast("string")))
    mail = F.when(k % 3 == 1, _quoted(F.concat(F.lit("u"), k.cast("string"), F.lit("@a.in"))))
    more = (("segment", F.when(k % 3 == 2, _quoted(F.col("c_mktsegment")))), ("tags", F.when(k % 3 == 2, F.concat(F.lit("["), k.cast("string"), F.lit("]")))))
    entry = F.when(k % 2 == 0, _object(("id", ident), ("name", name), ("email", mail), *more)).otherwise(_object(("id", ident), ("Full_Name", name), ("email", mail), *more))
    table(spark, sf_dir, "customer").select(entry.alias("value")).write.text(where)
    return records.corpus(spark, where, {"id": ("id",), "name": ("name", "full_name"), "email": ("email",)}, multi_line=False).drop("file")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT 2 AS version, l AS label, CAST(sum(CASE l WHEN 'confirmed' THEN k % 5 WHEN 'potential' THEN k % 3 ELSE 1 END) AS BIGINT) AS n FROM c, (VALUES ('confirmed'), ('potential'), ('no_match')) v(l) WHERE k % 2 = 0 GROUP BY l
UNION ALL SELECT 1, 'confirmed_email', CAST(sum(k % 3) AS BIGINT) FROM c WHERE k % 2 = 1 UNION ALL SELECT 1, 'potential', count(*) FROM c WHERE k % 2 = 1""")
def expected_label_totals(spark, sf_dir):
    """Ground truths of both versions, one a customer, and what they expect in total."""
    k = F.col("c_custkey")
    text = k.cast("string")
    person = _object(("confirmed", (k % 5).cast("string")), ("potential", (k % 3).cast("string")), ("no_match", F.lit("1")))
    two = _object(("expected_results", _object((F.concat(F.lit("p"), text), person))))
    mails = _list(F.slice(F.array(F.lit('"a"'), F.lit('"b"')), F.lit(1), (k % 3).cast("int")))
    one = _object(("expected_confirmed", _object(("email", mails))), ("expected_potential", F.concat(F.lit('["'), text, F.lit('"]'))))
    return records.expected_totals(table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, two).otherwise(one).alias("json")))


@query("""SELECT s_name AS name, 's' || s_suppkey || '.com' AS domain, 'https://s' || s_suppkey || '.com/out' AS opt_out_url, CASE WHEN s_suppkey % 3 = 0 THEN 'alias' || s_suppkey || '.org' ELSE '' END AS domains, 'ask ' || s_suppkey AS instructions FROM supplier""")
def catalog_entries(spark, sf_dir):
    """Suppliers as brokers in catalogs of fifty, some a bare list, some an object with one, written to a shared folder and read back."""
    from ..sources.scratch import new_path

    where, k = new_path(spark, "catalogs"), F.col("s_suppkey")
    text = k.cast("string")
    other = F.when(k % 3 == 0, F.concat(F.lit('["alias'), text, F.lit('.org"]')))
    broker = _object(("name", _quoted(F.col("s_name"))), ("domain", _quoted(F.concat(F.lit("s"), text, F.lit(".com")))), ("optOutUrl", _quoted(F.concat(F.lit("https://s"), text, F.lit(".com/out")))), ("instructions", _quoted(F.concat(F.lit("ask "), text))), ("domains", other))
    g = table(spark, sf_dir, "supplier").select(F.floor(k / 50).alias("g"), broker.alias("b")).groupBy("g").agg(F.collect_list("b").alias("bs"))
    one = F.when(F.col("g") % 2 == 0, _list("bs")).otherwise(_object(("brokers", _list("bs"))))
    g.select(one.alias("value")).write.option("maxRecordsPerFile", 1).text(where)
    return records.catalog(spark, where).select("name", "domain", "opt_out_url", F.array_join("domains", ",").alias("domains"), "instructions")
