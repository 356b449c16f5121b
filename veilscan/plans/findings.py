"""Queries over candidates, explanations, extraction states and recorded inputs; values come from keys, so that all cases occur."""

import hashlib

from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import names
from ..functions import normalize as N
from ..operators import candidates as C
from ..operators import entities as E
from ..operators import monitor as M
from ..operators import prefix as P
from ..sources import records
from .identity import _ACT, _C, _S, _SEV, _TH, GRID, customers, grid, judged, suppliers
from .pii import _MAILS, found
from .registry import SQL, query, table

_LOGIN_IF = "CASE WHEN o_orderkey % 3 = 0 THEN 'CHANGE_PASSWORD,CHECK_PASSWORD_REUSE,ENABLE_MFA,REVOKE_SESSIONS,' ELSE '' END || 'REQUEST_REMOVAL,REVIEW_VISIBILITY'"
_PAGE_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"""SELECT 'b' || o_orderkey AS candidate_id, 'breaches' AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'CREDENTIAL_EXPOSURE' ELSE 'BREACH_RECORD' END AS exposure_type, 'B' || o_orderkey AS entity, 'B' || o_orderkey AS entity_masked, 'CONFIRMED' AS match_label,
  CAST(0.9 AS DOUBLE) AS identity_confidence, CAST(1 AS DOUBLE) AS evidence_confidence, 'CRITICAL' AS severity, 100 AS rank, 'CREDENTIAL_STUFFING,ACCOUNT_TAKEOVER,TARGETED_PHISHING' AS threats, {_LOGIN_IF} AS actions, 'v1.0.0' AS rule_version,
  'https://b.example/' || o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'document' ELSE 'snippet' END AS tier, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS sure, 'B' || o_orderkey AS source_id, strftime(o_orderdate, '%Y-%m-%d') AS found_at, NULL AS content_sha256 FROM orders
UNION ALL SELECT 'p' || page_id, 'brokers', 'DATA_BROKER_LISTING', CASE WHEN page_id % 5 = 0 THEN 'catalog.example' ELSE {_PAGE_HOST} END, CASE WHEN page_id % 5 = 0 THEN 'The Catalog' ELSE {_PAGE_HOST} END, 'POTENTIAL', 0.5, CASE WHEN page_id % 3 = 0 THEN 0.9 ELSE 0.5 END, 'MEDIUM', 60, 'PRIVACY_COMMERCIALIZATION',
  'VERIFY_BEFORE_ACTION,OPT_OUT_BROKER', 'v1.0.0', url, CASE WHEN page_id % 3 = 0 THEN 'document' ELSE 'snippet' END, CASE WHEN page_id % 3 = 0 THEN 0.9 ELSE 0.5 END, 'p' || page_id, NULL, CASE WHEN page_id % 3 = 0 THEN sha256(html) END FROM pages""")
def exposure_candidates(spark, sf_dir):
    """Orders as breach results and pages as broker results, as one list of candidates."""
    k, p = F.col("o_orderkey"), F.col("page_id")
    tier = lambda c: F.when(c, "document").otherwise("snippet")
    name = F.concat(F.lit("B"), k.cast("string"))
    b = C.breach_candidates(table(spark, sf_dir, "orders").withColumn("candidate_id", F.concat(F.lit("b"), k.cast("string"))), k % 3 == 0, source=F.lit("breaches"), source_id=name, url=F.concat(F.lit("https://b.example/"), k.cast("string")), tier=tier(k % 4 == 0), found_at=F.col("o_orderdate"))
    pages = table(spark, sf_dir, "pages").withColumn("candidate_id", F.concat(F.lit("p"), p.cast("string")))
    listed = p % 5 == 0
    s = C.broker_candidates(pages, F.when(p % 2 == 0, F.lit("https://x")), F.when(listed, F.lit("The Catalog")), F.when(listed, F.lit("catalog.example")), source=F.lit("brokers"), source_id=F.col("candidate_id"), url=F.col("url"), domain=N.domain(F.col("url")), tier=tier(p % 3 == 0), content_sha256=F.when(p % 3 == 0, F.sha2("html", 256)))
    e = F.get("evidence", 0)
    plain = [x for x in s.columns if x not in ("threats", "actions", "evidence")]
    return C.united(b, s).select(*plain, F.array_join("threats", ",").alias("threats"), F.array_join("actions", ",").alias("actions"), e["url"].alias("url"), e["tier"].alias("tier"), e["confidence"].alias("sure"), e["source_id"].alias("source_id"), F.date_format(e["found_at"], "yyyy-MM-dd").alias("found_at"), e["content_sha256"].alias("content_sha256"))


@query(f"""WITH {GRID} SELECT id, concat_ws(',', CASE WHEN email THEN 'EMAIL' WHEN phone THEN 'PHONE' WHEN username THEN 'USERNAME' WHEN attested THEN 'ATTESTED_PHONE' WHEN name THEN 'NAME' END, CASE WHEN org THEN 'ORGANIZATION+0.05' END, CASE WHEN location THEN 'LOCATION+0.03' END,
  CASE WHEN sources >= 2 THEN 'SOURCES+0.05' END, CASE WHEN common THEN 'COMMON_NAME-0.10' END, CASE WHEN NOT exact AND name AND raw > 50 THEN 'CAP:NAME_ONLY_0.50' END, CASE WHEN NOT exact AND attested AND least(raw, CASE WHEN name THEN 50 ELSE raw END) > 75 THEN 'CAP:ATTESTED_PHONE_0.75' END,
  CASE WHEN exact AND raw > 98 THEN 'CAP:OVERALL_0.98' END) AS reasons FROM g""")
def confidence_reasons(spark, sf_dir):
    return grid(spark, sf_dir).select("id", F.array_join("c.reasons", ",").alias("reasons"))


_ASKED = "CASE c_custkey % 6 WHEN 0 THEN '\"u' || c_custkey || '@a.in\"' WHEN 1 THEN ' u' || c_custkey || '@a.in ' WHEN 2 THEN 'call u' || c_custkey || '@a.in' WHEN 3 THEN 'u' || c_custkey || '@a' WHEN 4 THEN 'u' || c_custkey END"


@query("SELECT c_custkey, c_custkey % 6 IN (0, 1) AS email_shaped FROM customer")
def email_shaped_queries(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.is_email_shaped(F.expr(_ASKED)).alias("email_shaped"))


@query(f"""WITH {GRID}, s AS (SELECT id, {_SEV} AS severity FROM g) SELECT id FROM s WHERE severity = 'HIGH' ORDER BY id DESC LIMIT 50""")
def findings_newest(spark, sf_dir):
    """The list of high findings, newest first: the fifty that a page shows."""
    j = judged(spark, sf_dir).select("id", F.col("s.severity").alias("severity"))
    return C.newest_first(C.at_least(j, "HIGH")).select("id").limit(50)


@query(f"""WITH m AS (SELECT doc_id, count(*) AS n FROM ({_MAILS}) GROUP BY 1), d AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS t FROM documents)
SELECT doc_id, trim(coalesce(t, '')) = '' AS skipped, length(coalesce(t, '')) > 20000 AS truncated, trim(coalesce(t, '')) <> '' AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR length(t) > 20000) AS partial,
  CASE WHEN trim(coalesce(t, '')) = '' THEN 0 ELSE coalesce(n, 0) END AS entities FROM d LEFT JOIN m USING (doc_id)""")
def extraction_status(spark, sf_dir):
    """Documents of which every eleventh is blank, and a recognizer that failed for every fifth and left a tail of every seventh."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    f = found(spark, sf_dir, D.emails)
    none = f.select("doc_id", "type", F.col("raw").alias("text"), F.lit(0.5).alias("score"), "start", "end").limit(0)
    status = d.select("doc_id", (F.col("doc_id") % 5 == 0).alias("failed"), (F.col("doc_id") % 7 != 0).alias("covered"))
    return E.extracted(d, f, none, status).select("doc_id", "skipped", "truncated", "partial", F.size("entities").cast("long").alias("entities"))


# Structured address at [10, 22 + k % 5); a recognizer's address from 10 + k % 30 on, six long, and a person of four from 12 + k % 14 on.
_SPANS = "SELECT o_orderkey AS k, 22 + o_orderkey % 5 AS e, 10 + o_orderkey % 30 AS ms, 12 + o_orderkey % 14 AS ps, CAST(0.4 + (o_orderkey % 6) / 10.0 AS DOUBLE) AS score FROM orders"


@query(f"""WITH s AS ({_SPANS}) SELECT k AS doc_id, 'EMAIL' AS type, 10 AS start, CASE WHEN ms < e THEN 'fused' ELSE 'regex' END AS detector, CASE WHEN ms < e THEN 'regex,ner' ELSE 'regex' END AS provenance, CASE WHEN ms < e THEN score END AS ner_score FROM s
UNION ALL SELECT k, 'EMAIL', ms, 'ner', 'ner', score FROM s WHERE ms >= e UNION ALL SELECT k, 'PERSON', ps, 'ner', 'ner', score FROM s WHERE NOT ps + 4 <= e""")
def ner_fusion_cases(spark, sf_dir):
    """Orders as documents: spans that overlap, lie inside, reach over or stand apart, by their keys."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("doc_id"), (22 + k % 5).cast("int").alias("e"), (10 + k % 30).cast("int").alias("ms"), (12 + k % 14).cast("int").alias("ps"), (0.4 + (k % 6) / 10.0).cast("double").alias("score"))
    f = o.select("doc_id", F.lit("EMAIL").alias("type"), F.lit("a@b.in").alias("raw"), F.lit("a@b.in").alias("normalized"), F.lit(0.95).alias("confidence"), F.array(F.lit("regex")).alias("provenance"), F.lit(10).alias("start"), F.col("e").alias("end"))
    row = lambda kind, s, n: F.struct(F.lit(kind).alias("type"), F.lit("x").alias("text"), F.col("score"), F.col(s).alias("start"), (F.col(s) + n).alias("end"))
    n = o.select("doc_id", F.explode(F.array(row("EMAIL", "ms", 6), row("PERSON", "ps", 4))).alias("n")).select("doc_id", "n.*")
    out = E.fuse(f, n)
    return out.select("doc_id", "type", "start", "detector", F.array_join("provenance", ",").alias("provenance"), "ner_score")


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 12 AS d FROM orders) SELECT k AS doc_id, 0 AS start, 0.9::DOUBLE AS score FROM s UNION ALL SELECT k, CAST(d AS INTEGER), 0.6::DOUBLE FROM s WHERE d > 0 AND greatest(10 - d, 0) * 2 < 20 - greatest(10 - d, 0)""")
def ner_dedupe_cases(spark, sf_dir):
    """Two spans of ten, moved against each other: they are one if they share half of what they cover."""
    d = (F.col("o_orderkey") % 12).cast("int")
    span = lambda s, score: F.struct(F.lit("person").alias("label"), F.lit("x").alias("text"), F.lit(score).alias("score"), s.alias("start"), (s + 10).alias("end"))
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(span(d, 0.6), span(F.lit(0), 0.9))).alias("n")).select("doc_id", "n.*")
    return E.deduplicated(n).select("doc_id", "start", "score")


@query(f"""WITH c AS ({_C}), s AS ({_S}), p AS (SELECT c_custkey, c.f AS cf, c.l AS cl, s.f AS sf, s.l AS sl, c.f = s.f OR (length(s.f) = 1 AND starts_with(c.f, s.f)) AS mf, c.l = s.l AS ml FROM c JOIN s ON c_custkey = s_suppkey)
SELECT c_custkey AS id, concat_ws(' ', CASE WHEN NOT mf THEN cf END, CASE WHEN NOT ml THEN cl END) AS unmatched_a, concat_ws(' ', CASE WHEN NOT mf THEN sf END, CASE WHEN NOT ml THEN sl END) AS unmatched_b FROM p""")
def name_unmatched(spark, sf_dir):
    both = customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), names.tokens(F.col("name")).alias("a")).join(suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("id"), names.tokens(F.col("name")).alias("b")), "id")
    m = names.unmatched(F.col("a"), F.col("b"))
    return both.select("id", m.alias("m")).select("id", F.array_join("m.a", " ").alias("unmatched_a"), F.array_join("m.b", " ").alias("unmatched_b"))


@query("""WITH o AS (SELECT 'u' || o_custkey AS email, 'B' || (o_orderkey % 20) AS name, CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' ELSE 'critical' END AS severity, o_orderkey % 3 = 0 AS pw FROM orders),
d AS (SELECT email, name, max(severity) AS severity, arg_max(pw, (severity, pw)) AS pw FROM o GROUP BY ALL)
SELECT email, array_to_string(list(name ORDER BY name), ',') AS names, count(*) FILTER (pw) AS with_passwords, array_to_string(list(name || ':' || severity ORDER BY name), ',') AS details FROM d GROUP BY email""")
def breach_lists(spark, sf_dir):
    """Recorded answers of one breach each, some of them recorded again."""
    k = F.col("o_orderkey")
    level = F.get(F.array(*[F.lit(x) for x in ("low", "High", "medium", "critical")]), (k % 4).cast("int"))
    b = F.struct(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("email"), F.concat(F.lit("B"), (k % 20).cast("string")).alias("breach_name"), level.alias("severity"), (k % 3 == 0).alias("passwords_included"))
    got = records.breach_lists(table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(b).alias("breaches"))).alias("json")))
    return got.select("email", F.array_join("names", ",").alias("names"), "with_passwords", F.array_join(F.transform("details", lambda d: F.concat(d["name"], F.lit(":"), d["severity"])), ",").alias("details"))


@query("""SELECT 1 AS version, 'p' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 2, p || c_custkey, c_name FROM customer, (VALUES ('p'), ('q')) v(p) WHERE c_custkey % 2 = 0""")
def ground_truth_profiles(spark, sf_dir):
    """Ground truths of one profile and of two, as JSON, read back."""
    one = lambda p: F.struct(F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    text = F.when(F.col("c_custkey") % 2 == 1, F.to_json(F.struct(one("p").alias("target_profile")))).otherwise(F.to_json(F.struct(F.array(one("p"), one("q")).alias("target_profiles"))))
    return records.ground_truth(table(spark, sf_dir, "customer").select(text.alias("json"))).select("version", "id", "name")


@query("""SELECT 'doc' || (page_id // 5) AS source, 'person' AS label, 'n' || page_id AS text, CAST(page_id AS INTEGER) AS start FROM pages""")
def ner_answers(spark, sf_dir):
    """Recorded answers of five entities for each document, nested, as rows."""
    p = table(spark, sf_dir, "pages").withColumn("g", F.floor(F.col("page_id") / 5))
    e = F.struct(F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("text"), F.lit("person").alias("label"), F.lit(0.5).alias("score"), F.col("page_id").cast("int").alias("start"), (F.col("page_id") + 3).cast("int").alias("end"))
    g = p.groupBy("g").agg(F.collect_list(e).alias("entities"))
    doc = F.struct(F.concat(F.lit("doc"), F.col("g").cast("string")).alias("source"), F.col("entities"))
    return records.ner_rows(g.select(F.to_json(F.struct(F.array(doc).alias("extracted_from"))).alias("json"))).select("source", "label", "text", "start")


_EV = "SELECT user_id || '|' || event_type AS fingerprint, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS scan, CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS severity, ts, user_id, event_type FROM events"


@query(f"""WITH e AS ({_EV}), s AS (SELECT fingerprint, arg_max(severity, (scan, severity)) AS severity, min(scan) AS first_scan, max(scan) AS last_scan FROM e WHERE scan < 12 AND user_id % 3 > 0 GROUP BY 1), n AS (SELECT fingerprint, arg_max(severity, (scan, severity)) AS severity, max(scan) AS scan FROM e WHERE scan >= 12 AND user_id % 5 > 0 GROUP BY 1)
SELECT coalesce(s.fingerprint, n.fingerprint) AS fingerprint, coalesce(n.severity, s.severity) AS severity, coalesce(first_scan, scan) AS first_scan, greatest(last_scan, scan) AS last_scan FROM s FULL JOIN n ON s.fingerprint = n.fingerprint""")
def upsert_fingerprints(spark, sf_dir):
    """Findings of the first days for some users, and those of later days, for others, put on top."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("scan"), F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("severity"), "user_id")
    stored = e.filter("scan < 12 and user_id % 3 > 0").groupBy("fingerprint").agg(F.max_by("severity", F.struct("scan", "severity")).alias("severity"), F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"))
    return M.upserted(stored, e.filter("scan >= 12 and user_id % 5 > 0").select("fingerprint", "severity", "scan"))


@query(f"""WITH e AS ({_EV}) SELECT user_id AS identity, event_type AS source, min(scan) AS first_scan, max(scan) AS last_scan, min(ts) AS first_at, max(ts) AS last_at FROM e GROUP BY ALL""")
def seen_times(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("identity"), F.col("event_type").alias("source"), F.lit("e").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("scan"), "ts")
    return M.seen_times(s).drop("entity")


@query("""WITH g AS (SELECT c_custkey AS u FROM customer WHERE c_custkey % 7 = 0) SELECT 'events' AS name, count(*) AS n, NULL AS hashes FROM events WHERE user_id NOT IN (SELECT u FROM g) UNION ALL SELECT 'orders', count(*), NULL FROM orders WHERE o_custkey NOT IN (SELECT u FROM g)
UNION ALL SELECT 'audit', count(*), count(DISTINCT CASE WHEN user_id IN (SELECT u FROM g) THEN sha256(CAST(user_id AS VARCHAR)) END) FROM events""")
def erasure_everywhere(spark, sf_dir):
    """What is left of two tables when some customers are erased, and their audit trail under hashes."""
    e = table(spark, sf_dir, "events")
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select("c_custkey")
    left, audit = M.erased_everywhere({"events": (e, "user_id"), "orders": (table(spark, sf_dir, "orders"), "o_custkey")}, gone, e)
    count = lambda name, df, h: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), h.alias("hashes"))
    hashes = F.count_distinct(F.when(F.length("user_id") == 64, F.col("user_id")))
    out = count("audit", audit, hashes)
    for name, df in left.items():
        out = out.unionByName(count(name, df, F.lit(None).cast("long")))
    return out


@query("SELECT DISTINCT o_custkey AS \"user\", l_suppkey AS identity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_linenumber = 1")
def live_identities(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("identity"))
    return M.live_identities(f, table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("identity")))


@query("SELECT o_custkey AS \"user\", count(*) AS identifiers, count(*) FILTER (o_orderstatus <> 'O') AS protected FROM orders GROUP BY 1")
def protected_identifiers(spark, sf_dir):
    """Orders as identifiers; those that are open stand in a finding."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("identifier"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"))
    return M.protected(o, o)


def _hmac_sql(key: bytes, message: str) -> str:
    """A keyed hash in SQL: two hashes over padded keys, which are constants."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    outer, inner = (bytes(b ^ x for b in key).hex() for x in (0x5C, 0x36))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(f"SELECT page_id, {_hmac_sql(b'cache', 'lower(url)')} AS key FROM pages")
def cache_keys(spark, sf_dir):
    asked = F.concat(F.lit("  "), F.upper("url"), F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", M.cache_key(b"cache", asked).alias("key"))


SQL["hmac_key"] = f"SELECT event_id, {_hmac_sql(b'key', '''user_id || ':' || json_extract_string(props, '$.k')''')} AS key FROM events"
SQL["pii_phone_multi_span"] = """WITH n AS (SELECT c_custkey, '9' || lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS a, '8' || lpad(CAST(c_custkey * 104729 % 1000000000 AS VARCHAR), 9, '0') AS b FROM customer)
SELECT c_custkey, '+91' || a AS normalized, 5 AS start, 15 AS "end" FROM n UNION ALL SELECT c_custkey, '+91' || b, 16, 26 FROM n"""

_LOCAL = "'9' || lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"


@query(f"""WITH c AS (SELECT c_custkey, {_LOCAL} AS n FROM customer) SELECT c_custkey AS identity_id, o_orderkey AS doc_id, c_custkey % 2 = 0 AS phone, c_custkey % 2 = 1 AS attested FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0""")
def match_phone_local(spark, sf_dir):
    """Customers' numbers as people write them, against numbers in international form; every second document has a number that is nobody's."""
    n = F.concat(F.lit("9"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, F.concat(F.lit("+91 "), n)).when(k == 1, F.concat(F.lit("0"), n)).otherwise(F.concat(F.left(n, F.lit(5)), F.lit("-"), F.right(n, F.lit(5))))
    c = table(spark, sf_dir, "customer").withColumn("n", n)
    null = [F.lit(None).cast("string").alias(x) for x in ("email", "username", "name", "organization", "location")]
    i = c.select(F.col("c_custkey").alias("identity_id"), said.alias("phone"), (F.col("c_custkey") % 2 == 0).alias("is_phone_verified"), *null)
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "n"), "o_custkey")
    value = F.concat(F.lit("+91"), F.when(F.col("o_orderkey") % 2 == 0, F.col("n")).otherwise(F.concat(F.lit("6"), F.right("n", F.lit(9)))))
    return E.signals(i, o.select(F.col("o_orderkey").alias("doc_id"), F.lit("PHONE").alias("type"), value.alias("normalized"))).select("identity_id", "doc_id", "phone", "attested")


_MENTIONS = ["email", "phone", "name", "org", "location", "pan"]
_M = ", ".join(f"(o_orderkey * 2654435761 % 65536 >> {i}) % 2 = 1 AS {m}" for i, m in enumerate(_MENTIONS))


@query(f"""WITH m AS (SELECT o_custkey AS identity_id, o_orderkey AS doc_id, {_M} FROM orders), l AS (SELECT *, phone AND identity_id % 2 = 0 AS verified, phone AND identity_id % 2 = 1 AS attested FROM m WHERE email OR phone OR name),
r AS (SELECT *, email OR verified AS exact, CAST(org AS INTEGER) + CAST(location AS INTEGER) AS cor, CASE WHEN email OR verified THEN 90 WHEN attested THEN 60 ELSE 30 END + 5 * CAST(org AS INTEGER) + 3 * CAST(location AS INTEGER) AS raw FROM l),
c AS (SELECT *, CASE WHEN NOT exact AND name THEN least(raw, 50) WHEN NOT exact THEN least(raw, 75) ELSE least(raw, 98) END / 100.0 AS confidence, CASE WHEN exact OR (name AND cor >= 2) THEN 'CONFIRMED' ELSE 'POTENTIAL' END AS label FROM r)
SELECT identity_id, doc_id, CASE WHEN pan THEN 'GOVT_ID_EXPOSURE' WHEN phone THEN 'PUBLIC_PHONE' WHEN email THEN 'PUBLIC_EMAIL' ELSE 'PUBLIC_PROFILE' END AS exposure_type, CAST(confidence AS DOUBLE) AS confidence, label AS match_label,
  CASE WHEN pan AND label = 'CONFIRMED' THEN 'CRITICAL' WHEN pan THEN 'HIGH' WHEN label = 'CONFIRMED' AND phone AND location THEN 'HIGH' WHEN label = 'CONFIRMED' AND phone AND email AND CAST(name AS INTEGER) + CAST(org AS INTEGER) + CAST(location AS INTEGER) >= 1 THEN 'HIGH' WHEN label = 'CONFIRMED' AND (phone OR email) THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c""")
def correlate_signals(spark, sf_dir):
    """Orders as documents that name their customers by some of address, number, name, firm and place, by the key's bits; nobody shares a name."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey").cast("string")
    number = F.concat(F.lit("9"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    i = c.select(F.col("c_custkey").alias("identity_id"), F.concat(F.lit(" U"), k, F.lit("@A.in")).alias("email"), number.alias("phone"), (F.col("c_custkey") % 2 == 0).alias("is_phone_verified"), F.lit(None).cast("string").alias("username"), F.concat(F.lit("X"), k, F.lit(" Q"), k).alias("name"), F.col("c_mktsegment").alias("organization"), F.col("n_name").alias("location"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("identity_id")).join(i, "identity_id")
    bit = lambda n: F.expr(f"shiftright(doc_id * 2654435761 % 65536, {_MENTIONS.index(n)}) % 2 = 1")
    said = {"email": ("EMAIL", F.lower(F.trim("email"))), "phone": ("PHONE", F.concat(F.lit("+91"), "phone")), "name": ("PERSON", F.upper("name")), "org": ("ORGANIZATION", F.concat(F.lit("the "), "organization")), "location": ("LOCATION", F.lower("location")), "pan": ("PAN", F.lit("ABCPE1234F"))}
    e = o.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(bit(n), F.struct(F.lit(t).alias("type"), v.alias("normalized"))) for n, (t, v) in said.items()]))).alias("e")).select("doc_id", "e.*")
    return E.outcomes(E.signals(i, e)).select("identity_id", "doc_id", "exposure_type", "confidence", "match_label", "severity")


_SAID = "lower(replace({}, '_', ' '))"
_TODO = f"CASE WHEN len({_ACT}) = 0 THEN 'REVIEW_VISIBILITY' ELSE array_to_string({_ACT}, ',') END"
SQL["template_explanation"] = f"""WITH {GRID}, {_TH}, x AS (SELECT id, kind, conf, codes, {_SEV} AS level, {_TODO} AS todo FROM t)
SELECT id, CASE WHEN contains(kind, 'CREDENTIAL') OR list_contains(codes, 'CREDENTIAL_STUFFING') THEN level || ' credential exposure at a.example' WHEN contains(kind, 'BROKER') THEN 'Data broker listing at a.example'
  WHEN contains(kind, 'GOVT_ID') OR list_contains(codes, 'IDENTITY_FRAUD_ENABLEMENT') THEN level || ' government identifier exposure at a.example' ELSE level || ' personal data exposure at a.example (confidence ' || CAST(round(conf * 100) AS INTEGER) || '%)' END
  || ': ' || {_SAID.format("array_to_string(codes, ' and ')")} || '.' || CASE WHEN level NOT IN ('CRITICAL', 'HIGH') AND conf < 0.6 THEN ' Confidence is low; verify ownership first.' ELSE '' END || ' Next: ' || {_SAID.format("replace(todo, ',', ', ')")} || '.' AS summary FROM x"""


#: Spellings of addresses, and whether they are blocked: loopback, link-local, private, multicast and translated ones, mapped
#: ones by what they map, whatever way they are spelled; what is no address.
_V6 = {
    "::1": True, "0:0:0:0:0:0:0:1": True, "::": True, "fe80::7": True, "fd12::2": True, "ff02::1": True, "64:ff9b::a": True, "::ffff:8.8.8.8": False,
    "::ffff:808:808": False, "::ffff:10.0.0.1": True, "0:0:0:0:0:FFFF:7f00:1": True, "2001:4860::": False, "2a00:1450::1:8": False, "fec0::1": False, "zz:1": True,
    "1::2::3": True, "1:2:3:4:5:6:7": True, "::ffff:300.1.1.1": True, "nonsense": True, "300.1.1.1": True, "169.254.169.254": True, "8.8.4.4": False,
}
_V6_LIST = ", ".join(f"({i}, '{ip}', {str(b).upper()})" for i, (ip, b) in enumerate(_V6.items()))


@query(f"""SELECT DISTINCT ip, blocked FROM orders JOIN (VALUES {_V6_LIST}) AS v(i, ip, blocked) ON o_orderkey % {len(_V6)} = i""")
def ipv6_block(spark, sf_dir):
    """Orders as addresses to screen, in every spelling."""
    from ..operators import web

    ip = F.get(F.array(*[F.lit(x) for x in _V6]), (F.col("o_orderkey") % len(_V6)).cast("int"))
    return web.screened(table(spark, sf_dir, "orders").select(ip.alias("ip")).distinct()).select("ip", "blocked")


_ROUTE = "(p_partkey * 2654435761) % 4294967296"


@query(f"""WITH a AS (SELECT o_orderkey, ({_ROUTE.replace('p_partkey', '(o_custkey % 200)')} + (o_orderkey % 64) * 40503) % 4294967296 AS v FROM orders), r AS (SELECT DISTINCT p_partkey, 8 + p_partkey % 23 AS n, ({_ROUTE}) >> (24 - p_partkey % 23) AS prefix FROM part),
m AS (SELECT o_orderkey, n, min(p_partkey) AS route FROM a JOIN r ON a.v >> (32 - n) = prefix GROUP BY ALL)
SELECT a.o_orderkey, arg_max(route, n) AS route, CAST(max(n) AS INTEGER) AS length FROM a LEFT JOIN m USING (o_orderkey) GROUP BY 1""")
def route_longest_prefix(spark, sf_dir):
    """Orders as addresses, parts as routes of 8 to 30 bits: the longest route that holds each address."""
    v = lambda x: F.concat_ws(".", *[(F.shiftrightunsigned(x, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    of_key = F.expr("((o_custkey % 200) * 2654435761 + (o_orderkey % 64) * 40503) % 4294967296")
    a = table(spark, sf_dir, "orders").select("o_orderkey", P.address(v(of_key)).alias("ip"))
    net = P.address(v(F.expr(_ROUTE)))
    n = (F.lit(104) + F.col("p_partkey") % 23).cast("int")
    cut = F.coalesce(*[F.when(n == k, P.bits(net, k)) for k in range(104, 127)])
    r = table(spark, sf_dir, "part").select(n.alias("length"), cut.alias("prefix"), F.col("p_partkey").alias("route"), (n - 96).alias("n"))
    return P.longest(a, "ip", r).select("o_orderkey", "route", F.col("n").alias("length"))


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '44' WHEN 2 THEN '91' ELSE '7' END || lpad(CAST((c_custkey * 7919) % 1000000000 AS VARCHAR), 9, '0') AS number FROM customer),
p AS (SELECT prefix, min(area) AS area FROM (SELECT '1' AS prefix, 'NANP' AS area UNION ALL SELECT '44', 'UK' UNION ALL SELECT '91', 'IN' UNION ALL SELECT CASE s_suppkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '44' ELSE '91' END || lpad(CAST((s_suppkey * 37) % 1000 AS VARCHAR), 3, '0'), 'area ' || s_suppkey FROM supplier) GROUP BY 1)
SELECT c_custkey, arg_max(area, length(prefix)) AS area FROM c LEFT JOIN p ON starts_with(number, prefix) GROUP BY 1""")
def numbering_areas(spark, sf_dir):
    """Numbers of customers and the area of the numbering plan that the longest of its prefixes says."""
    code = lambda k, n, *cs: F.get(F.array(*[F.lit(c) for c in cs]), (k % n).cast("int"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    number = F.concat(code(c, 4, "1", "44", "91", "7"), F.lpad(((c * 7919) % 1000000000).cast("string"), 9, "0"))
    plans = spark.createDataFrame([("1", "NANP"), ("44", "UK"), ("91", "IN")], "prefix string, area string")
    areas = table(spark, sf_dir, "supplier").select(F.concat(code(s, 3, "1", "44", "91"), F.lpad(((s * 37) % 1000).cast("string"), 3, "0")).alias("prefix"), F.concat(F.lit("area "), s.cast("string")).alias("area"))
    t = plans.unionByName(areas).select(F.length("prefix").alias("length"), "prefix", "area")
    return P.longest(table(spark, sf_dir, "customer").select("c_custkey", number.alias("number")), "number", t, P.leading).select("c_custkey", "area")


@query("""WITH h AS (SELECT page_id % 50 AS h, CASE page_id % 3 WHEN 0 THEN '10.0.0.' || (page_id % 250) ELSE '8.8.8.' || (page_id % 250) END AS ip FROM pages WHERE page_id % 50 <> 49) SELECT 'h' || h AS host, bool_or(starts_with(ip, '10.')) AS blocked FROM h GROUP BY h UNION ALL SELECT 'nothing', TRUE""")
def hosts_blocked(spark, sf_dir):
    """Hosts with the addresses that they resolve to; one has none."""
    from ..operators import web

    p = F.col("page_id")
    ip = F.when(p % 3 == 0, F.concat(F.lit("10.0.0."), (p % 250).cast("string"))).otherwise(F.concat(F.lit("8.8.8."), (p % 250).cast("string")))
    h = table(spark, sf_dir, "pages").filter("page_id % 50 <> 49").groupBy(F.concat(F.lit("h"), (p % 50).cast("string")).alias("host")).agg(F.collect_set(ip).alias("addresses"))
    none = table(spark, sf_dir, "region").limit(1).select(F.lit("nothing").alias("host"), F.array().cast("array<string>").alias("addresses"))
    return web.hosts_blocked(h.unionByName(none))


@query("""SELECT page_id, CASE WHEN page_id % 5 IN (2, 3) THEN 'unsupported_content_type' WHEN octet_length(encode(html)) > 524288 THEN 'page_too_large' END AS reason FROM pages""")
def content_admission(spark, sf_dir):
    from ..operators import web

    kind = F.get(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "application/pdf", "image/png", "", "Text/HTML")]), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", web.fetch_reason(F.col("url"), F.col("html"), kind).alias("reason"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'u' || c_custkey || '@x.in' WHEN 1 THEN '+91' || (c_custkey + 9000000000) WHEN 2 THEN 'user' || c_custkey ELSE 'two words ' || c_custkey END AS identifier,
CASE c_custkey % 4 WHEN 0 THEN 'u' || c_custkey || '@x.in' WHEN 1 THEN '+91' || (c_custkey + 9000000000) WHEN 2 THEN '@User' || c_custkey ELSE 'Two  Words ' || c_custkey END AS entity FROM customer""")
def identifier_forms(spark, sf_dir):
    """Identifiers and entities as people write them, in their normal forms."""
    k, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    kind = F.when(k == 0, "EMAIL").when(k == 1, "PHONE").when(k == 2, "USERNAME").otherwise("NAME")
    number = (F.col("c_custkey") + 9000000000).cast("string")
    said = F.when(k == 0, F.concat(F.lit(" U"), key, F.lit("@X.in "))).when(k == 1, F.concat(F.lit("+91 "), F.left(number, F.lit(5)), F.lit("-"), F.right(number, F.lit(5)))).when(k == 2, F.concat(F.lit(" @User"), key)).otherwise(F.concat(F.lit(" Two  Words "), key, F.lit(" ")))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"), said.alias("said"))
    return c.select("id", N.identifier(F.col("kind"), F.col("said")).alias("identifier"), N.entity(F.col("kind"), F.col("said"), D.e164(F.col("said"))).alias("entity"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain FROM pages""")
def clean_domains(spark, sf_dir):
    """Domains out of loose text: here the pages' addresses, each in another form."""
    rest = F.regexp_replace("url", "^[A-Za-z]+://", "")
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.upper(F.regexp_extract(rest, "^[^/?#]+", 0)), F.lit(":8080/x "))).otherwise(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+", 0))
    return table(spark, sf_dir, "pages").select("page_id", N.clean_domain(text).alias("domain"))


@query("""SELECT doc_id, len(string_split(left(text, 400), '')) AS points, CAST(length(left(text, 400)) + 2 * (doc_id % 3) AS INTEGER) AS units FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE text IS NOT NULL AND text <> '')""")
def utf16_offsets(spark, sf_dir):
    """Offsets behind the beginning of each text, with none to two pairs of characters beyond the basic plane put before it."""
    from ..functions import text as T

    d = table(spark, sf_dir, "documents").filter("text is not null and text <> ''")
    begin, extra = F.left("text", F.lit(400)), (F.col("doc_id") % 3).cast("int")
    made = F.concat(F.repeat(F.lit("\U0001F600\U0001F601"), extra), begin)
    offset = F.length(made)
    return d.select("doc_id", F.length(begin).cast("long").alias("points"), (T.utf16_offset(made, offset) - 2 * extra).cast("int").alias("units"))


@query("SELECT 'orders' AS input, count(*) AS n, count(*) >= 10 AS ok FROM orders UNION ALL SELECT 'region', count(*), count(*) >= 6 FROM region")
def input_integrity(spark, sf_dir):
    return records.integrity({"orders": (table(spark, sf_dir, "orders"), 10), "region": (table(spark, sf_dir, "region"), 6)})


@query("SELECT event_type AS source, user_id % 4 AS scan_id, count(*) AS n FROM events GROUP BY ALL")
def stream_persisted(spark, sf_dir):
    """Sightings written as they come, a micro-batch at a time under its number, so a batch that is run again is written once."""
    from ..sources.scratch import new_path
    from ..streaming import lifecycle as S
    from .monitoring import _staged

    out = new_path(spark, "stream")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("scan_id"), F.col("event_type").alias("source"), "event_id")
    S.apply_scans(_staged(rows, spark), lambda batch, number: records.publish(batch, out, number), new_path(spark, "log")).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("source", "scan_id").agg(F.count("*").alias("n"))


_LETTERS = "lower(left(p_name, 5))"


@query(f"""WITH a AS (SELECT DISTINCT {_LETTERS} AS inner_text FROM part UNION SELECT DISTINCT 'd ' || left(split_part(p_name, ' ', 2), 3) FROM part), b AS (SELECT DISTINCT p_name || ' of ' || (p_partkey % 300) AS outer_text FROM part)
SELECT inner_text, outer_text FROM a JOIN b ON contains(outer_text, inner_text)""")
def contained_names(spark, sf_dir):
    """Pieces of names, some of two words, and the names that they lie in."""
    from ..operators.contain import containing

    p = table(spark, sf_dir, "part")
    inner = p.select(F.lower(F.left("p_name", F.lit(5))).alias("inner_text")).union(p.select(F.concat(F.lit("d "), F.left(F.split("p_name", " ")[1], F.lit(3)))))
    outer = p.select(F.concat("p_name", F.lit(" of "), (F.col("p_partkey") % 300).cast("string")).alias("outer_text"))
    return containing(inner, outer, "inner_text", "outer_text")


@query(SQL["upsert_fingerprints"])
def upsert_committed(spark, sf_dir):
    """As ``upsert_fingerprints``, in a committed table: the first days as one version, later ones on top of the buckets that they touch."""
    from ..sources import committed
    from ..sources.scratch import new_path

    where = new_path(spark, "committed")
    e = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("scan"), F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("severity"), "user_id")
    shape = "fingerprint string, severity string, first_scan int, last_scan int"
    first = e.filter("scan < 12 and user_id % 3 > 0").groupBy("fingerprint").agg(F.max_by("severity", F.struct("scan", "severity")).alias("severity"), F.min("scan").cast("int").alias("first_scan"), F.max("scan").cast("int").alias("last_scan"))
    committed.write(first, where, "fingerprint", 16, "first")
    later = e.filter("scan >= 12 and user_id % 5 > 0").select("fingerprint", "severity", "scan")
    stored = spark.createDataFrame([], shape).schema
    committed.upsert(later, where, "fingerprint", lambda old, new: M.upserted(old, new).select(*stored.names), 16, "later", stored)
    return committed.read(spark, where, stored)


@query("""WITH p AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) AS position FROM pages)
SELECT 'person' || (page_id // 50) AS person_id, 'search' AS query, url AS title, url, 's' || page_id AS snippet, CAST(position AS INTEGER) AS position FROM p""")
def stream_recorded_searches(spark, sf_dir):
    """Pages recorded as search answers in files of a shared folder, read as a stream of discovery rows."""
    from ..sources.scratch import new_path
    from .monitoring import _drained

    where = new_path(spark, "searches")
    p = table(spark, sf_dir, "pages").withColumn("g", F.floor(F.col("page_id") / 50))
    result = F.struct("page_id", F.struct("url", F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("snippet")).alias("r"))
    answers = p.groupBy("g").agg(F.array_sort(F.collect_list(result)).alias("rs"))
    search = F.struct(F.concat(F.lit("person"), F.col("g").cast("string")).alias("person_id"), F.lit("search").alias("query"), F.transform("rs", lambda x: x["r"]).alias("results"))
    # a file for each answer
    answers.select("g", F.array(search).alias("searches")).repartition(8, "g").write.partitionBy("g").option("maxRecordsPerFile", 1).json(where)
    spark.dataSource.register(records.RecordedSearch)
    return _drained(spark.readStream.format("recorded_search").load(where), spark)
