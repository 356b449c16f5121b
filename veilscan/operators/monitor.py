"""Findings over scans: sightings, lifecycle, summaries, quotas and scan states.

A scan marks the sources that it evaluated; only in these can a finding be absent, so an outage never advances absence.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import hmac_sha256
from ..functions.rules import bumped

#: Fixed value: absences in a row that close a finding.
CLOSES = 3


def strongest(sightings: DataFrame, keys: list[str], tier: str = "tier", position: str = "position") -> DataFrame:
    """One sighting of a finding in a scan: the first of the document tier, else the first."""
    w = Window.partitionBy(*keys).orderBy(F.desc((F.col(tier) == "document").cast("int")), position)
    return sightings.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def evaluated(sightings: DataFrame, scans: DataFrame) -> DataFrame:
    """Each finding (identity, source, entity) in each scan of its source from its first sighting on, with ``seen``.

    ``scans`` are the (identity, source, scan) that ran; findings meet their scans by key. A sighting in a scan that
    didn't run its source doesn't count."""
    sightings = sightings.join(scans.select("identity", "source", "scan").distinct(), ["identity", "source", "scan"], "left_semi")
    first = sightings.groupBy("identity", "source", "entity").agg(F.min("scan").alias("first_scan"))
    grid = first.join(scans.select("identity", "source", "scan").distinct(), ["identity", "source"]).filter("scan >= first_scan").drop("first_scan")
    hits = sightings.select("identity", "source", "entity", "scan").distinct().withColumn("seen", F.lit(True))
    return grid.join(hits, ["identity", "source", "entity", "scan"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def lifecycle(grid: DataFrame, base: str = "MEDIUM") -> DataFrame:
    """The state of each finding after each scan, in closed form: runs of absences are islands between sightings."""
    keys = ["identity", "source", "entity"]
    w = Window.partitionBy(*keys).orderBy("scan")
    g = grid.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("seen").over(w))
    g = g.withColumn("island", F.sum(F.col("seen").cast("int")).over(w))
    run = Window.partitionBy(*keys, "island").orderBy("scan")
    g = g.withColumn("absences", F.when(F.col("seen"), 0).otherwise(F.row_number().over(run) - 1))
    state = (
        F.when(F.col("seen") & (F.col("n") == 1), "FIRST_SEEN")
        .when(F.col("seen") & ~F.col("before"), "REAPPEARED")
        .when(F.col("seen") & (F.col("n") == 2), "ACTIVE")
        .when(F.col("seen"), "UNCHANGED")
        .when(F.col("absences") >= CLOSES, "CLOSED")
        .otherwise("NOT_FOUND")
    )
    # the absence after a closed one starts to count anew: closed findings stay closed
    g = g.withColumn("state", state)
    bumps = F.sum((F.col("state") == "REAPPEARED").cast("int")).over(w)
    return g.select(*keys, "scan", "state", F.col("absences").cast("int").alias("absences"), bumped(F.lit(base), bumps).alias("severity"))


def marked_lifecycle(grid: DataFrame) -> DataFrame:
    """The state of each finding after each scan where people mark findings as remediated, in closed form.

    ``grid`` is that of ``evaluated`` with ``marked``. A mark counts in a scan that doesn't see the finding, while it isn't
    closed: so the first mark among the first CLOSES absences of a run decides the rest of it. ``step`` is one transition."""
    keys = ["identity", "source", "entity"]
    w = Window.partitionBy(*keys).orderBy("scan")
    g = grid.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("seen").over(w)).withColumn("island", F.sum(F.col("seen").cast("int")).over(w))
    run = Window.partitionBy(*keys, "island")
    g = g.withColumn("away", F.row_number().over(run.orderBy("scan")) - 1)
    g = g.withColumn("mark", F.min(F.when(F.col("marked") & ~F.col("seen"), F.col("away"))).over(run))
    done = (F.col("mark") <= CLOSES) & (F.col("away") >= F.col("mark"))
    state = (
        F.when(F.col("seen") & (F.col("n") == 1), "FIRST_SEEN")
        .when(F.col("seen") & ~F.col("before"), "REAPPEARED")
        .when(F.col("seen") & (F.col("n") == 2), "ACTIVE")
        .when(F.col("seen"), "UNCHANGED")
        .when(F.coalesce(done, F.lit(False)), "REMEDIATED")
        .when(F.col("away") >= CLOSES, "CLOSED")
        .otherwise("NOT_FOUND")
    )
    counts = ~F.col("seen") & ~F.coalesce(done, F.lit(False)) & (F.col("away") <= CLOSES)
    return g.select(*keys, "scan", state.alias("state"), F.when(counts, F.col("away")).otherwise(0).cast("int").alias("absences"))


def step(state: Column, absences: Column, seen: Column, marked: Column) -> Column:
    """One transition: struct(state, absences, bump)."""
    made = lambda s, n, b=False: F.struct(F.lit(s).alias("state") if isinstance(s, str) else s.alias("state"), n.cast("int").alias("absences"), F.lit(b).alias("bump"))
    zero, done = F.lit(0), state.isin("REMEDIATED", "CLOSED")
    return (
        F.when(marked & (state.isNull() | ~done), made("REMEDIATED", zero))
        .when(state.isNull(), made("FIRST_SEEN", zero))
        .when(seen & (done | (state == "NOT_FOUND")), made("REAPPEARED", zero, True))
        .when(seen & (state == "FIRST_SEEN"), made("ACTIVE", zero))
        .when(seen, made("UNCHANGED", zero))
        .when(done, made(state, zero))
        .when(absences + 1 >= CLOSES, made("CLOSED", absences + 1))
        .otherwise(made("NOT_FOUND", absences + 1))
    )


def apply_scan(stored: DataFrame, sightings: DataFrame, scans: DataFrame, scan: Column) -> DataFrame:
    """Stored findings after one scan: a full outer join of sightings and state; rows that weren't evaluated stay as they are.

    ``stored``: identity, source, entity, state, absences, severity, first_scan, last_scan. Existing findings keep their severity unless they reappear."""
    keys = ["identity", "source", "entity"]
    s = strongest(sightings, keys).select(*keys, F.lit(True).alias("hit"), F.col("severity").alias("new_severity"))
    ran = scans.select("identity", "source", F.lit(True).alias("ran")).distinct()
    both = stored.join(s, keys, "full_outer").join(ran, ["identity", "source"], "left")
    seen = F.coalesce("hit", F.lit(False))
    both = both.withColumn("t", step(F.col("state"), F.coalesce("absences", F.lit(0)), seen, F.lit(False)))
    touched = seen | F.coalesce("ran", F.lit(False))
    level = F.when(F.col("state").isNull(), F.col("new_severity")).when(F.col("t.bump"), bumped(F.col("severity"))).otherwise(F.col("severity"))
    pick = lambda a, b: F.when(touched, a).otherwise(b)
    return both.select(*keys, pick(F.col("t.state"), F.col("state")).alias("state"), pick(F.col("t.absences"), F.col("absences")).alias("absences"), pick(level, F.col("severity")).alias("severity"), F.coalesce("first_scan", scan).alias("first_scan"), F.when(seen, scan).otherwise(F.col("last_scan")).alias("last_scan"), F.when(touched, F.when(F.col("state").isNull(), "created").when(F.col("t.state") == "REAPPEARED", "reappeared").when((F.col("t.state") == "CLOSED") & (F.col("state") != "CLOSED"), "closed").otherwise("updated")).alias("change"))


def summary(changes: DataFrame) -> DataFrame:
    """How many findings of an identity a scan created, updated, saw again, closed."""
    return changes.groupBy("identity").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("created", "updated", "reappeared", "closed")])


def snapshot(states: DataFrame) -> DataFrame:
    """One row for each identity with a map of its findings to their states. Findings of an identity are what its owner sees at once."""
    entry = F.struct(F.col("fingerprint"), F.struct("state", "severity", "scan").alias("v"))
    return states.groupBy("identity").agg(F.max("scan").alias("last_scan"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("findings"))


def quota(calls: DataFrame, limit: int, length: str = "24 hours") -> DataFrame:
    """Calls of a user and kind in fixed windows: count, whether the limit is exceeded, seconds until the window ends."""
    w = calls.groupBy("user", "kind", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return w.select("user", "kind", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("exceeded"), F.when(F.col("n") > limit, F.ceil(F.col("w.end").cast("double") - F.col("last").cast("double"))).otherwise(0).cast("long").alias("retry_after"))


def scan_status(sources: DataFrame) -> DataFrame:
    """A scan's status from its sources': skipped ones don't count."""
    s = sources.groupBy("scan").agg(F.count_if(F.col("status") != "SKIPPED").alias("n"), F.count_if(F.col("status") == "OK").alias("ok"))
    return s.select("scan", F.when((F.col("n") == 0) | (F.col("ok") == 0), "FAILED").when(F.col("ok") == F.col("n"), "COMPLETED").otherwise("PARTIAL").alias("status"))


def source_status(calls: DataFrame) -> DataFrame:
    """A source's status in a scan from its calls: unavailable only if all failed; the last error is named."""
    s = calls.groupBy("scan", "source").agg(F.count("*").alias("n"), F.count_if("failed").alias("f"), F.max_by("error", F.when(F.col("failed"), F.col("seq"))).alias("last"))
    return s.select("scan", "source", F.when(F.col("f") == F.col("n"), "UNAVAILABLE").otherwise("OK").alias("status"), F.when(F.col("f") > 0, F.concat(F.col("f").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" failed: "), F.coalesce("last", F.lit("")))).alias("message"))


def stale(scans: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Queued and running scans that began (or were made) too long ago become partial."""
    old = F.col("status").isin("QUEUED", "RUNNING") & (F.coalesce("started", "created") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return scans.withColumn("status", F.when(old, "PARTIAL").otherwise(F.col("status")))


def newest(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def retained(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    return rows.filter(F.col(at) > now - F.make_dt_interval(hours=F.lit(hours)))


def cache_lookup(queries: DataFrame, cache: DataFrame, hours: int = 6) -> DataFrame:
    """``queries`` (key, asked) with the newest cached row not older than ``hours`` at that time, and ``hit``; repeated queries are one row.

    Both stand in one order by key and time, and each query takes the last cached time before it: no row meets all rows of its key."""
    kind = queries.schema["asked"].dataType
    asks = queries.select("key", F.col("asked").alias("at"), F.lit(None).cast(kind).alias("made"), F.lit(1).alias("ask")).distinct()
    made = F.col("created").cast(kind)
    rows = asks.unionByName(cache.select("key", made.alias("at"), made.alias("made"), F.lit(0).alias("ask")))
    before = Window.partitionBy("key").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("last", F.last("made", ignorenulls=True).over(before)).filter("ask = 1")
    fresh = F.when(F.col("last") > F.col("at") - F.make_dt_interval(hours=F.lit(hours)), F.col("last"))
    return rows.select("key", F.col("at").alias("asked"), fresh.alias("cached_at"), fresh.isNotNull().alias("hit"))


def cache_key(key: bytes, query: Column) -> Column:
    """The key under which a query's answer is cached: a keyed hash of the query in its plain form, so a cache holds no query."""
    return hmac_sha256(key, F.lower(F.trim(F.regexp_replace(query, r"\s+", " "))))


def erased(rows: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows of users that didn't ask for erasure."""
    return rows.join(users.select(F.col(users.columns[0]).alias(user)).distinct(), user, "left_anti")


def erased_everywhere(tables: dict[str, tuple[DataFrame, str]], users: DataFrame, audit: DataFrame | None = None, audit_user: str = "user_id") -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Every table (frame, user column) without the rows of erased users (the first column of ``users``), and the audit trail,
    whose rows stay with a hash in the erased user's place. A user whose audit rows are hashed already is not hashed again."""
    gone = users.select(F.col(users.columns[0]).cast("string").alias("__gone")).distinct()
    left = {name: df.join(gone, df[user].cast("string") == gone["__gone"], "left_anti") for name, (df, user) in tables.items()}
    if audit is None:
        return left, None
    marked = audit.withColumn("__user", F.col(audit_user).cast("string")).join(gone, F.col("__user") == F.col("__gone"), "left")
    hidden = F.when(F.col("__gone").isNotNull(), F.sha2("__user", 256)).otherwise(F.col("__user"))
    return left, marked.withColumn(audit_user, hidden).drop("__user", "__gone")


def live_identities(findings: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Distinct (user, identity) whose identifiers still stand."""
    return findings.select("user", "identity").join(identifiers.select("identity").distinct(), "identity", "left_semi").select("user", "identity").distinct()


def protected(identifiers: DataFrame, findings: DataFrame) -> DataFrame:
    """By user: identifiers, and those of them that no open finding names."""
    open_ = findings.filter(~F.col("status").isin("REMEDIATED", "CLOSED")).select("user", "identifier").distinct().withColumn("exposed", F.lit(1))
    both = identifiers.select("user", "identifier").distinct().join(open_, ["user", "identifier"], "left")
    return both.groupBy("user").agg(F.count("*").alias("identifiers"), F.count_if(F.col("exposed").isNull()).alias("protected"))


def seen_times(sightings: DataFrame) -> DataFrame:
    """By finding: the first and the last scan that saw it, and when."""
    return sightings.groupBy("identity", "source", "entity").agg(F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), F.min_by("ts", F.struct("scan", "ts")).alias("first_at"), F.max_by("ts", F.struct("scan", "ts")).alias("last_at"))


def upserted(stored: DataFrame, rows: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Stored findings with the rows of a scan: a row of a known key updates it (first_scan stays), a new key is added, others are as they were.

    ``stored`` and ``rows``: the key, severity, scan columns of the same names; of repeated keys in ``rows`` the last scan counts."""
    others = [c for c in rows.columns if c not in (key, "scan")]
    new = rows.groupBy(key).agg(F.max("scan").alias("scan"), *[F.max_by(c, F.struct("scan", c)).alias(f"new_{c}") for c in others])
    both = stored.join(new, key, "full_outer")
    return both.select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in others], F.coalesce("first_scan", "scan").alias("first_scan"), F.greatest("last_scan", "scan").alias("last_scan"))


def audit_safe(rows: DataFrame, metadata: str = "metadata", user: str = "user_id") -> DataFrame:
    """Audit rows with hashed users and without keys that name sensitive fields."""
    safe = F.map_filter(metadata, lambda k, v: ~k.rlike("(?i)(email|phone|aadhaar|pan|password|document|raw)"))
    return rows.withColumn(metadata, safe).withColumn(user, F.sha2(F.col(user).cast("string"), 256))


#: The words of the sentence that a list of findings shows.
SENTENCE = (" was found on ", " as a ", " tied to one of your verified identifiers.")


def finding_view(findings: DataFrame) -> DataFrame:
    """What a list of findings shows: defaults filled in, display status, sentence, primary evidence."""
    kind = F.lower(F.replace(F.col("exposure_type"), F.lit("_"), F.lit(" ")))
    first = F.get("evidence", 0)
    return findings.select(
        "id",
        F.coalesce(first["title"], F.concat(F.col("entity_masked"), F.lit(" ("), kind, F.lit(")"))).alias("title"),
        F.when(F.col("severity").isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), F.col("severity")).otherwise("LOW").alias("severity"),
        F.when(F.col("match_label") == "CONFIRMED", "CONFIRMED").otherwise("POTENTIAL").alias("confidence"),
        F.when(F.coalesce(first["url"], F.lit("")) != "", "Document").otherwise("Snippet").alias("tier"),
        F.when(F.col("status").isin("REMEDIATED", "CLOSED"), "REMEDIATED").when(F.col("status") == "REAPPEARED", "REAPPEARED").otherwise("ACTIVE").alias("status"),
        F.date_format("created", "yyyy-MM-dd").alias("discovered"),
        F.concat("entity_masked", F.lit(SENTENCE[0]), "source", F.lit(SENTENCE[1]), kind, F.lit(SENTENCE[2])).alias("explanation"),
    )


def redacted_finding(findings: DataFrame) -> DataFrame:
    """The fields that may leave: no value of a person, two decimals, defaults for what is missing.

    Columns that ``findings`` may lack (extraction_confidence, actions) are defaults then; the tier is the evidence's best."""
    has = lambda n, kind, none: F.coalesce(F.col(n), none).alias(n) if n in findings.columns else none.cast(kind).alias(n)
    two = lambda c: (F.floor(c * 100 + 0.5) / 100).cast("double")
    domains = F.array_distinct(F.array_compact(F.transform("evidence", lambda e: e["domain"])))
    fields = findings.schema["evidence"].dataType.elementType.names
    tiers = F.exists("evidence", lambda e: e["tier"] == "document") if "tier" in fields else F.lit(False)
    extraction = two(F.col("extraction_confidence")) if "extraction_confidence" in findings.columns else F.lit(None).cast("double")
    return findings.select(
        "id",
        F.coalesce("severity", F.lit("LOW")).alias("risk"),
        F.coalesce("exposure_type", F.lit("UNKNOWN")).alias("exposure_type"),
        F.coalesce(two(F.col("confidence")), F.lit(0.0)).alias("confidence"),
        F.coalesce(extraction, F.lit(0.0)).alias("extraction_confidence"),
        F.when(F.coalesce(tiers, F.lit(False)), "document").otherwise("snippet").alias("tier"),
        F.when(F.size(domains) > 0, F.array_sort(domains)).otherwise(F.array(F.lit("unknown"))).alias("domains"),
        F.coalesce("threats", F.array().cast("array<string>")).alias("threats"),
        has("actions", "array<string>", F.array().cast("array<string>")),
    )
