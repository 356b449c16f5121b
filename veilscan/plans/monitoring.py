"""Queries over events as scans and sightings: lifecycle, summaries, quotas, retention, streams.

A user is an identity, a day a scan, an event type a source, the key in props an entity; a user's purchase is a mark of
remediation, and a day with an error of the user is an outage of the source ``view``.
"""

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import candidates as C
from ..operators import monitor as M
from ..sources import records
from ..sources.scratch import new_path
from ..streaming import lifecycle as S
from .registry import SQL, query, table


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.select("event_id", "ts", F.col("user_id").alias("identity"), F.col("event_type").alias("source"), day.alias("scan"), F.get_json_object("props", "$.k").alias("entity"), "value")


_E = "SELECT event_id, ts, user_id AS identity, event_type AS source, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS scan, json_extract_string(props, '$.k') AS entity, value FROM events"
_SOURCES = "('signup', 'click', 'view')"


def sightings(spark, sf_dir):
    return events(spark, sf_dir).filter(f"source in {_SOURCES}").withColumn("entity", (F.col("entity").cast("int") % 10).cast("string"))


def scans(spark, sf_dir):
    """(identity, source, scan) that ran: days with any event; ``view`` doesn't run on days with an error."""
    e = events(spark, sf_dir)
    days = e.groupBy("identity", "scan").agg(F.bool_or(F.col("source") == "error").alias("outage"))
    return days.select("identity", "scan", "outage", F.explode(F.array(*[F.lit(s) for s in ("signup", "click", "view")])).alias("source")).filter("not (source = 'view' and outage)").drop("outage")


_SIGHT = f"s AS (SELECT event_id, ts, identity, source, scan, CAST(CAST(entity AS INTEGER) % 10 AS VARCHAR) AS entity, value FROM ({_E}) WHERE source IN {_SOURCES})"
_SCANS = f"""dy AS (SELECT identity, scan, bool_or(source = 'error') AS outage FROM ({_E}) GROUP BY 1, 2), sc AS (SELECT identity, scan, src AS source FROM dy, (VALUES ('signup'), ('click'), ('view')) v(src) WHERE NOT (src = 'view' AND outage))"""
_COUNTED = "ok AS (SELECT s.* FROM s SEMI JOIN sc ON s.identity = sc.identity AND s.source = sc.source AND s.scan = sc.scan)"
_GRID = f"""{_SIGHT}, {_SCANS}, {_COUNTED}, f AS (SELECT identity, source, entity, min(scan) AS first FROM ok GROUP BY ALL),
h AS (SELECT DISTINCT identity, source, entity, scan FROM ok),
g AS (SELECT f.identity, f.source, f.entity, sc.scan, h.scan IS NOT NULL AS seen FROM f JOIN sc ON f.identity = sc.identity AND f.source = sc.source AND sc.scan >= f.first
  LEFT JOIN h ON h.identity = f.identity AND h.source = f.source AND h.entity = f.entity AND h.scan = sc.scan),
w AS (SELECT *, row_number() OVER k AS n, lag(seen) OVER k AS before, coalesce(max(CASE WHEN seen THEN scan END) OVER k, -1) AS last_seen FROM g WINDOW k AS (PARTITION BY identity, source, entity ORDER BY scan)),
a AS (SELECT *, CASE WHEN seen THEN 0 ELSE count(*) OVER (PARTITION BY identity, source, entity, last_seen ORDER BY scan) - CASE WHEN last_seen >= 0 AND max(CAST(seen AS INTEGER)) OVER (PARTITION BY identity, source, entity, last_seen) = 1 THEN 1 ELSE 0 END END AS absences FROM w),
st AS (SELECT identity, source, entity, scan, CAST(absences AS INTEGER) AS absences, CASE WHEN seen AND n = 1 THEN 'FIRST_SEEN' WHEN seen AND NOT before THEN 'REAPPEARED' WHEN seen AND n = 2 THEN 'ACTIVE' WHEN seen THEN 'UNCHANGED' WHEN absences >= 3 THEN 'CLOSED' ELSE 'NOT_FOUND' END AS state FROM a),
l AS (SELECT *, ['MEDIUM', 'HIGH', 'CRITICAL'][CAST(least(2, sum(CAST(state = 'REAPPEARED' AS INTEGER)) OVER (PARTITION BY identity, source, entity ORDER BY scan)) AS INTEGER) + 1] AS severity FROM st)"""


def grid(spark, sf_dir):
    """Evaluated scans; a sighting on a day that its source didn't run doesn't count."""
    return M.evaluated(sightings(spark, sf_dir), scans(spark, sf_dir))


@query(f"WITH {_SIGHT} SELECT identity, source, entity, scan, event_id FROM (SELECT *, row_number() OVER (PARTITION BY identity, source, entity, scan ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, event_id) AS n FROM s) WHERE n = 1")
def scan_dedupe_strongest(spark, sf_dir):
    s = sightings(spark, sf_dir).withColumn("tier", F.when(F.col("value") > 50, "document").otherwise("snippet"))
    return M.strongest(s, ["identity", "source", "entity", "scan"], position="event_id").select("identity", "source", "entity", "scan", "event_id")


@query(f"WITH {_GRID} SELECT * FROM l")
def lifecycle_states(spark, sf_dir):
    return M.lifecycle(grid(spark, sf_dir))


@query(f"WITH {_GRID} SELECT scan, count(*) FILTER (state = 'FIRST_SEEN') AS created, count(*) FILTER (state IN ('ACTIVE', 'UNCHANGED')) AS confirmed, count(*) FILTER (state = 'REAPPEARED') AS reappeared, count(*) FILTER (state = 'CLOSED' AND absences = 3) AS closed FROM l GROUP BY scan")
def lifecycle_summary(spark, sf_dir):
    s = F.col("state")
    return M.lifecycle(grid(spark, sf_dir)).groupBy("scan").agg(F.count_if(s == "FIRST_SEEN").alias("created"), F.count_if(s.isin("ACTIVE", "UNCHANGED")).alias("confirmed"), F.count_if(s == "REAPPEARED").alias("reappeared"), F.count_if((s == "CLOSED") & (F.col("absences") == 3)).alias("closed"))


@query(f"WITH {_SIGHT}, {_SCANS}, k AS (SELECT DISTINCT identity, source FROM s) SELECT k.identity, k.source, dy.scan FROM k JOIN dy ON k.identity = dy.identity WHERE k.source = 'view' AND dy.outage")
def outage_gate(spark, sf_dir):
    """Scans of an identity in which a source of its findings didn't run: nothing is absent there."""
    k = sightings(spark, sf_dir).select("identity", "source").distinct()
    days = events(spark, sf_dir).select("identity", "scan").distinct()
    return k.join(days, "identity").join(scans(spark, sf_dir), ["identity", "source", "scan"], "left_anti")


@query(f"WITH {_GRID} SELECT severity, count(*) AS n FROM l GROUP BY 1")
def severity_bump(spark, sf_dir):
    return M.lifecycle(grid(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"))


_LAST = "z AS (SELECT identity, source, entity, arg_max(state, scan) AS state, arg_max(severity, scan) AS severity, max(scan) AS scan FROM l GROUP BY ALL)"


@query(f"WITH {_GRID}, {_LAST} SELECT identity, max(scan) AS last_scan, count(*) AS findings, count(*) FILTER (state = 'CLOSED') AS closed FROM z GROUP BY identity")
def monitoring_snapshot(spark, sf_dir):
    last = M.lifecycle(grid(spark, sf_dir)).groupBy("identity", "source", "entity").agg(*[F.max_by(c, "scan").alias(c) for c in ("state", "severity")], F.max("scan").alias("scan"))
    snap = M.snapshot(last.withColumn("fingerprint", N.fingerprint(F.col("identity"), F.col("source"), F.lit("KEY"), F.col("entity"))))
    closed = F.size(F.filter(F.map_values("findings"), lambda v: v["state"] == "CLOSED"))
    return snap.select("identity", "last_scan", F.size("findings").cast("long").alias("findings"), closed.cast("long").alias("closed"))


@query(f"""WITH {_GRID}, p AS (SELECT * FROM l WHERE scan < 20), z AS (SELECT identity, source, entity, arg_max(state, scan) AS state, arg_max(absences, scan) AS absences FROM p GROUP BY ALL),
now AS (SELECT DISTINCT identity, source, entity FROM s WHERE scan = 20), ran AS (SELECT identity, source FROM sc WHERE scan = 20),
j AS (SELECT coalesce(z.identity, now.identity) AS identity, coalesce(z.source, now.source) AS source, z.state, z.absences, now.identity IS NOT NULL AS seen FROM z FULL JOIN now ON z.identity = now.identity AND z.source = now.source AND z.entity = now.entity),
t AS (SELECT j.*, ran.identity IS NOT NULL OR seen AS touched FROM j LEFT JOIN ran ON j.identity = ran.identity AND j.source = ran.source)
SELECT identity, count(*) FILTER (touched AND state IS NULL) AS created, count(*) FILTER (touched AND state IS NOT NULL AND NOT (seen AND state IN ('CLOSED', 'NOT_FOUND')) AND NOT (NOT seen AND state <> 'CLOSED' AND absences + 1 >= 3)) AS updated,
  count(*) FILTER (touched AND seen AND state IN ('CLOSED', 'NOT_FOUND')) AS reappeared, count(*) FILTER (touched AND NOT seen AND state <> 'CLOSED' AND absences + 1 >= 3) AS closed FROM t GROUP BY identity""")
def rescan_summary(spark, sf_dir):
    """The scan of day 20 against the state after day 19."""
    before = M.lifecycle(grid(spark, sf_dir)).filter("scan < 20")
    stored = before.groupBy("identity", "source", "entity").agg(*[F.max_by(c, "scan").alias(c) for c in ("state", "absences", "severity")], F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"))
    today = sightings(spark, sf_dir).filter("scan = 20").select("identity", "source", "entity", F.lit("snippet").alias("tier"), F.col("event_id").alias("position"), F.lit("MEDIUM").alias("severity"))
    return M.summary(M.apply_scan(stored, today, scans(spark, sf_dir).filter("scan = 20"), F.lit(20)))


@query(f"""WITH RECURSIVE {_SIGHT}, {_SCANS}, mk AS (SELECT DISTINCT identity, scan FROM ({_E}) WHERE source = 'purchase'), {_COUNTED}, f AS (SELECT identity, source, entity, min(scan) AS first FROM ok GROUP BY ALL), h AS (SELECT DISTINCT identity, source, entity, scan FROM ok),
g AS (SELECT f.identity, f.source, f.entity, sc.scan, h.scan IS NOT NULL AS seen, mk.scan IS NOT NULL AS marked, row_number() OVER (PARTITION BY f.identity, f.source, f.entity ORDER BY sc.scan) AS n FROM f JOIN sc ON f.identity = sc.identity AND f.source = sc.source AND sc.scan >= f.first
  LEFT JOIN h ON h.identity = f.identity AND h.source = f.source AND h.entity = f.entity AND h.scan = sc.scan LEFT JOIN mk ON mk.identity = f.identity AND mk.scan = sc.scan AND h.scan IS NULL),
r AS (SELECT identity, source, entity, scan, n, CASE WHEN marked THEN 'REMEDIATED' WHEN seen THEN 'FIRST_SEEN' END AS state, 0 AS absences FROM g WHERE n = 1 AND seen
 UNION ALL SELECT g.identity, g.source, g.entity, g.scan, g.n, CASE WHEN marked AND r.state NOT IN ('REMEDIATED', 'CLOSED') THEN 'REMEDIATED' WHEN seen AND r.state IN ('REMEDIATED', 'CLOSED', 'NOT_FOUND') THEN 'REAPPEARED' WHEN seen AND r.state = 'FIRST_SEEN' THEN 'ACTIVE' WHEN seen THEN 'UNCHANGED' WHEN r.state IN ('REMEDIATED', 'CLOSED') THEN r.state WHEN r.absences + 1 >= 3 THEN 'CLOSED' ELSE 'NOT_FOUND' END,
  CASE WHEN marked AND r.state NOT IN ('REMEDIATED', 'CLOSED') THEN 0 WHEN seen OR r.state IN ('REMEDIATED', 'CLOSED') THEN 0 ELSE r.absences + 1 END FROM r JOIN g ON r.identity = g.identity AND r.source = g.source AND r.entity = g.entity AND g.n = r.n + 1)
SELECT identity, source, entity, scan, state, absences FROM r""")
def lifecycle_with_remediation(spark, sf_dir):
    """Findings over scans with marks of remediation; the SQL goes step by step."""
    return M.marked_lifecycle(ticks(spark, sf_dir))


def ticks(spark, sf_dir):
    """Evaluated scans of findings with marks: a purchase on a day without a sighting of the finding."""
    marks = events(spark, sf_dir).filter("source = 'purchase'").select("identity", "scan", F.lit(True).alias("mark")).distinct()
    g = grid(spark, sf_dir).join(marks, ["identity", "scan"], "left")
    return g.select("identity", "source", "entity", "scan", "seen", (F.coalesce("mark", F.lit(False)) & ~F.col("seen")).alias("marked"))


@query("""SELECT event_id, sha256(concat_ws(chr(0), CAST(user_id AS VARCHAR), lower(event_type), 'KEY', json_extract_string(props, '$.k'))) AS fingerprint FROM events""")
def fingerprint(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", N.fingerprint(F.col("identity"), F.col("source"), F.lit("key"), F.col("entity")).alias("fingerprint"))


@query()
def hmac_key(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", N.hmac_sha256(b"key", F.concat_ws(":", "identity", "entity")).alias("key"))


@query("""WITH w AS (SELECT user_id AS "user", event_type AS kind, time_bucket(INTERVAL 24 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL)
SELECT "user", kind, window_start, n, n > 2 AS exceeded, CASE WHEN n > 2 THEN CAST(ceil(epoch(window_start + INTERVAL 24 HOURS) - epoch(last)) AS BIGINT) ELSE 0 END AS retry_after FROM w""")
def quota_fixed_window(spark, sf_dir):
    q = M.quota(events(spark, sf_dir).select(F.col("identity").alias("user"), F.col("source").alias("kind"), F.col("ts").cast("timestamp").alias("ts")), 2)
    return q.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 6 HOURS")
def ttl_retention(spark, sf_dir):
    return M.retained(events(spark, sf_dir), "ts", F.lit("2024-01-20").cast("timestamp"), 6).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTES THEN 'PARTIAL' WHEN event_type = 'view' THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM events")
def stale_scans(spark, sf_dir):
    s = events(spark, sf_dir).select("event_id", F.when(F.col("source") == "view", "RUNNING").otherwise("COMPLETED").alias("status"), F.lit(None).cast("timestamp").alias("started"), F.col("ts").alias("created"))
    return M.stale(s, F.lit("2024-01-15").cast("timestamp")).select("event_id", "status")


_CALLS = "SELECT user_id AS scan, CASE WHEN event_type IN ('view', 'error') THEN 'view' ELSE event_type END AS source, event_type = 'error' OR event_id % 3 = 0 AS failed, 'e' || event_id AS error, event_id AS seq FROM events"


@query(f"WITH c AS ({_CALLS}) SELECT scan, source, CASE WHEN bool_and(failed) THEN 'UNAVAILABLE' ELSE 'OK' END AS status, CASE WHEN bool_or(failed) THEN count(*) FILTER (failed) || '/' || count(*) || ' failed: ' || arg_max(error, seq) FILTER (failed) END AS message FROM c GROUP BY ALL")
def source_status_fold(spark, sf_dir):
    s = F.when(F.col("source").isin("view", "error"), "view").otherwise(F.col("source"))
    e = events(spark, sf_dir).select(F.col("identity").alias("scan"), s.alias("source"), ((F.col("source") == "error") | (F.col("event_id") % 3 == 0)).alias("failed"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"), F.col("event_id").alias("seq"))
    return M.source_status(e)


_KIND = "CASE event_id % 5 WHEN 0 THEN 'SKIPPED' WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'UNAVAILABLE' ELSE 'OK' END ELSE CASE WHEN user_id % 2 = 0 THEN 'OK' ELSE 'UNAVAILABLE' END END"


@query(f"WITH s AS (SELECT user_id AS scan, {_KIND} AS status FROM events) SELECT scan, CASE WHEN count(*) FILTER (status = 'OK') = 0 THEN 'FAILED' WHEN count(*) FILTER (status = 'OK') = count(*) FILTER (status <> 'SKIPPED') THEN 'COMPLETED' ELSE 'PARTIAL' END AS status FROM s GROUP BY scan")
def scan_status_fold(spark, sf_dir):
    return M.scan_status(events(spark, sf_dir).withColumnRenamed("identity", "user_id").select(F.col("user_id").alias("scan"), F.expr(_KIND).alias("status")))


@query("""SELECT a.user_id AS key, a.ts AS asked, max(b.ts) AS cached_at, max(b.ts) IS NOT NULL AS hit FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view') a
LEFT JOIN events b ON b.event_type = 'click' AND b.user_id = a.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 6 HOURS GROUP BY ALL""")
def cache_lookup(spark, sf_dir):
    e = events(spark, sf_dir)
    ask = e.filter("source = 'view'").select(F.col("identity").alias("key"), F.col("ts").alias("asked")).distinct()
    return M.cache_lookup(ask, e.filter("source = 'click'").select(F.col("identity").alias("key"), F.col("ts").alias("created")))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def erasure_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select("c_custkey")
    return M.erased(events(spark, sf_dir), gone, "identity").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unlinked_findings(spark, sf_dir):
    """Findings whose identity has no live identifier."""
    live = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(live, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT o_custkey AS identity, bool_and(o_orderstatus IN ('F', 'O')) AS eligible FROM orders GROUP BY 1")
def scan_eligibility(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("identity")).agg(F.bool_and(F.col("o_orderstatus").isin("F", "O")).alias("eligible"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def one_active_scan(spark, sf_dir):
    return M.newest(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), ["o_custkey"], ["o_orderkey"], 1).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def latest_scans(spark, sf_dir):
    return M.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS user_hash, 1 AS n_keys FROM events")
def audit_sanitized(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("rawProps"), F.col("props"), F.lit("userEmail"), F.lit("x")).alias("metadata"))
    return M.audit_safe(rows).select("event_id", F.col("user_id").alias("user_hash"), F.size("metadata").alias("n_keys"))


def _breaches(spark, sf_dir):
    """Customers' orders as recorded breach answers."""
    o = table(spark, sf_dir, "orders")
    b = F.struct("o_orderkey", F.struct(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("email"), F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("breach_name"), F.get(F.array(*[F.lit(x) for x in ("low", "High", "medium", "critical")]), (F.col("o_orderkey") % 4).cast("int")).alias("severity"), (F.col("o_orderkey") % 3 == 0).alias("passwords_included")).alias("b"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(b)).alias("bs"))
    return g.select("o_custkey", F.transform("bs", lambda x: x["b"]).alias("breaches"))


@query("""WITH o AS (SELECT 'u' || o_custkey AS email, o_orderkey, o_orderkey % 3 = 0 AS pw, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END AS r FROM orders)
SELECT email, count(*) AS breaches, count(*) FILTER (pw) AS with_passwords, ['Low', 'Medium', 'High', 'Critical'][max(r)] AS risk_label FROM o GROUP BY email""")
def breach_metrics(spark, sf_dir):
    return records.breach_summary(_breaches(spark, sf_dir).select(F.to_json(F.struct("breaches")).alias("json")))


@query("""WITH o AS (SELECT o_custkey AS email, 'B' || o_orderkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total, o_orderkey FROM orders)
SELECT email, name, CAST(total AS INTEGER) AS total, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 = 0 ELSE email % 2 = 0 END AS credential FROM o WHERE n <= 25""")
def breach_cap(spark, sf_dir):
    """Names of breaches with details of every second one; the aggregate flag decides about the others."""
    b = _breaches(spark, sf_dir)
    names = b.select(F.col("o_custkey").alias("email"), F.to_json(F.struct(F.array(F.transform("breaches", lambda x: x["breach_name"])).alias("breaches"))).alias("json"))
    even = F.filter("breaches", lambda x: F.substring(x["breach_name"], 2, 20).cast("long") % 2 == 0)
    detail = F.transform(even, lambda x: F.struct(F.lower(x["breach_name"]).alias("name"), F.when(x["passwords_included"], F.array(F.lit("Email addresses"), F.lit("Passwords"))).otherwise(F.array(F.lit("Email addresses"))).alias("xposed_data")))
    strength = F.create_map(F.lit("PlainText"), F.when(F.col("o_custkey") % 2 == 0, 3).otherwise(0))
    metrics = b.select(F.col("o_custkey").alias("email"), F.to_json(F.struct(F.struct(detail.alias("get_details"), strength.alias("passwords_strength")).alias("BreachMetrics"))).alias("json"))
    return records.breach_rows(records.breach_names(names), records.breach_details(metrics)).select("email", "name", "total", "credential")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'CREDENTIAL_EXPOSURE' ELSE 'BREACH_RECORD' END AS exposure_type, 'CRITICAL' AS severity, 'CREDENTIAL_STUFFING,ACCOUNT_TAKEOVER,TARGETED_PHISHING' AS threats,
CASE WHEN o_orderkey % 3 = 0 THEN 'CHANGE_PASSWORD,CHECK_PASSWORD_REUSE,ENABLE_MFA,REVOKE_SESSIONS,' ELSE '' END || 'REQUEST_REMOVAL,REVIEW_VISIBILITY' AS actions FROM orders""")
def breach_candidates(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = C.breach_candidates(table(spark, sf_dir, "orders").withColumn("candidate_id", k), k % 3 == 0)
    return rows.select(F.col("candidate_id").alias("id"), "exposure_type", "severity", F.array_join("threats", ",").alias("threats"), F.array_join("actions", ",").alias("actions"))


@query("""SELECT page_id AS id, 'MEDIUM' AS severity, 60 AS rank, 'VERIFY_BEFORE_ACTION,OPT_OUT_BROKER' AS actions, CAST(CASE WHEN page_id % 3 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS evidence_confidence, 'PRIVACY_COMMERCIALIZATION' AS threats FROM pages""")
def broker_candidates(spark, sf_dir):
    p = F.col("page_id")
    rows = C.broker_candidates(table(spark, sf_dir, "pages").withColumn("candidate_id", p), F.lit("https://x"), tier=F.when(p % 3 == 0, "document").otherwise("snippet"))
    return rows.select(F.col("candidate_id").alias("id"), "severity", "rank", F.array_join("actions", ",").alias("actions"), "evidence_confidence", F.array_join("threats", ",").alias("threats"))


def _drained(stream, spark, mode: str = "append"):
    """What a stream has written once its input is read: a table in the shared folder."""
    root = new_path(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _staged(rows, spark):
    """Rows as files that a stream reads."""
    root = new_path(spark, "stream")
    rows.write.parquet(root)
    return spark.readStream.schema(rows.schema).parquet(root)


def _stateful(spark):
    """A session beside this one, for streams whose state has timers or expires."""
    own = spark.newSession()
    for key, value in S.PROVIDER.items():
        own.conf.set(key, value)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


@query(SQL["lifecycle_with_remediation"])
def stream_lifecycle(spark, sf_dir):
    own = _stateful(spark)
    return _drained(S.lifecycle_stream(_staged(ticks(own, sf_dir), own)), spark)


@query("""WITH e AS (SELECT user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS scan_id, ts, event_type FROM events WHERE event_type IN ('signup', 'click', 'purchase')),
b AS (SELECT scan_id, min(ts) FILTER (event_type = 'click') AS run, min(ts) FILTER (event_type = 'signup') AS queued, min(ts) FILTER (event_type = 'purchase') AS done FROM e GROUP BY 1),
w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e)
SELECT scan_id, CASE WHEN done IS NOT NULL THEN 'COMPLETED' ELSE 'PARTIAL' END AS status FROM b, w WHERE done IS NOT NULL OR coalesce(run, queued) + INTERVAL 10 MINUTE <= mark""")
def stream_stale_scans(spark, sf_dir):
    """A user's day as a scan: queued, running and completed by its events; timers close those that don't end."""
    own = _stateful(spark)
    e = events(own, sf_dir).filter("source in ('signup', 'click', 'purchase')")
    status = F.when(F.col("source") == "signup", "QUEUED").when(F.col("source") == "click", "RUNNING").otherwise("COMPLETED")
    rows = e.select((F.col("identity") * 100 + F.col("scan")).cast("long").alias("scan_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return _drained(S.stale_stream(_staged(rows, own)), spark).select("scan_id", "status")


@query("""SELECT user_id AS "user", event_type AS kind, count(*) AS n, count(*) > 2 AS exceeded FROM events WHERE ts < (SELECT time_bucket(INTERVAL 24 HOURS, max(ts) - INTERVAL 1 DAY, TIMESTAMP '1970-01-01') FROM events) GROUP BY user_id, event_type, time_bucket(INTERVAL 24 HOURS, ts, TIMESTAMP '1970-01-01')""")
def stream_quota(spark, sf_dir):
    """Windows that the watermark has passed when the input ends."""
    calls = events(spark, sf_dir).select(F.col("identity").alias("user"), F.col("source").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return _drained(S.quota_stream(_staged(calls, spark), 2), spark).select("user", "kind", "n", "exceeded")


@query(f"WITH {_SIGHT} SELECT DISTINCT identity, source, entity, scan FROM s")
def stream_dedupe(spark, sf_dir):
    s = sightings(spark, sf_dir).select("identity", "source", "entity", "scan", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(S.once(_staged(s, spark), ["identity", "source", "entity", "scan"], "40 days"), spark).drop("ts")
