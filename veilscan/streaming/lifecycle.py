"""Structured Streaming forms of the stateful operators."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CLOSES = 3


def advance(state: str | None, absences: int, seen: bool, marked: bool) -> tuple[str, int, bool]:
    """One transition of a finding: new state, absences, whether severity rises. The batch form is ``operators.monitor.step``."""
    done = state in ("REMEDIATED", "CLOSED")
    if marked and not done:
        return "REMEDIATED", 0, False
    if state is None:
        return "FIRST_SEEN", 0, False
    if seen:
        return ("REAPPEARED", 0, True) if done or state == "NOT_FOUND" else ("ACTIVE" if state == "FIRST_SEEN" else "UNCHANGED", 0, False)
    if done:
        return state, 0, False
    return ("CLOSED" if absences + 1 >= CLOSES else "NOT_FOUND"), absences + 1, False


#: The state store that typed state, timers and expiry need; a session that runs these streams must name it.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Minutes after which a scan is stale; hours for which an answer is kept.
STALE_MINUTES, CACHE_HOURS = 10, 6


#: Parts into which keys are dealt, one group of state each: what a group costs (calls of Python, batches, round trips to the
#: state store) is paid by part, and rows and findings cost a loop over them.
PARTS = 512


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))


class Lifecycle(StatefulProcessor):
    """State, absences and last scan of the findings of one part, kept by identity and source, as a scan marks all of these; stored findings may be given as initial state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.findings = handle.getMapState("findings", "identity long, source string", "entities array<string>, states array<string>, absences array<int>, lasts array<int>")

    def _known(self, owner: tuple) -> dict:
        return {e: tuple(x) for e, *x in zip(*got)} if (got := self.findings.getValue(owner)) else {}

    def _keep(self, owners: dict) -> None:
        for owner, known in owners.items():
            if known:
                self.findings.updateValue(owner, (list(known), *(list(x) for x in zip(*known.values()))))

    def handleInitialState(self, key, initial, timerValues) -> None:
        owners: dict[tuple, dict] = {}
        for *owner, entity, state, absences, last in zip(*(initial[c].tolist() for c in ("identity", "source", "entity", "state", "absences", "last"))):
            owner = tuple(owner)
            if owner not in owners:
                owners[owner] = self._known(owner)
            owners[owner][entity] = (state, absences, last)
        self._keep(owners)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["scan", "seen"])
        any_kept = self.findings.exists()
        owners: dict[tuple, dict] = {}
        out = []
        for identity, source, entity, scan, seen, marked in zip(*(got[c].tolist() for c in ("identity", "source", "entity", "scan", "seen", "marked"))):
            owner = (identity, source)
            if owner not in owners:
                owners[owner] = self._known(owner) if any_kept else {}
            now, absences, last = owners[owner].get(entity, (None, 0, -1))
            if scan <= last or (now is None and not seen):
                continue
            now, absences, _ = advance(now, absences, seen, marked)
            owners[owner][entity] = (now, absences, scan)
            out.append((identity, source, entity, scan, now, absences))
        self._keep(owners)
        yield pd.DataFrame(out, columns=["identity", "source", "entity", "scan", "state", "absences"])

    def close(self) -> None:
        pass


def lifecycle_stream(ticks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """States of findings from a stream of (identity, source, entity, scan, seen, marked) rows, one for each scan that evaluated the finding's source.

    Rows of one batch are applied by scan; a row not after the last applied scan is dropped. ``stored``: findings (identity,
    source, entity, state, absences, last) to begin with, a batch table. The session must name ``PROVIDER``."""
    keys = ["identity", "source", "entity"]
    owner = keys[:2]
    begin = _dealt(stored.select(*keys, "state", "absences", "last"), *owner).groupBy("part") if stored is not None else None
    return _dealt(ticks.select(*keys, "scan", "seen", "marked"), *owner).groupBy("part").transformWithStateInPandas(Lifecycle(), "identity long, source string, entity string, scan int, state string, absences int", "append", "none", begin)


class StaleScans(StatefulProcessor):
    """The scans of one part that are under way, with one timer: when the first of them gets stale. What has not ended by then is closed as PARTIAL."""

    def __init__(self, minutes: int):
        self.most = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids array<long>, since array<long>, due long")

    def _known(self) -> tuple[dict, int | None]:
        ids, since, due = self.open.get() or ([], [], None)
        return dict(zip(ids, since)), due

    def _keep(self, known: dict, timer: int | None) -> None:
        """Stores what is under way; ``timer`` is the one that is set."""
        due = min(known.values()) + self.most if known else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if known:
            self.open.update((list(known), list(known.values()), due))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        ended = got[~got["status"].isin(["QUEUED", "RUNNING"])].sort_values(["micros", "status"]).drop_duplicates("scan_id")
        under_way = got[~got["scan_id"].isin(ended["scan_id"])]
        began = lambda x: dict(zip((g := x.groupby("scan_id")["micros"].min() // 1000).index.tolist(), g.tolist()))
        known, timer = self._known()
        for scan in ended["scan_id"].tolist():
            known.pop(scan, None)
        # a scan counts from when it started to run, else from when it was queued
        known = began(under_way) | known | began(under_way[under_way["status"] == "RUNNING"])
        self._keep(known, timer)
        yield ended[["scan_id", "status", "micros"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._known()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        stale = [(scan, "PARTIAL", (at + self.most) * 1000) for scan, at in known.items() if at + self.most <= now]
        # the timer that fired goes by itself
        self._keep({scan: at for scan, at in known.items() if at + self.most > now}, None)
        yield pd.DataFrame(stale, columns=["scan_id", "status", "micros"])

    def close(self) -> None:
        pass


def stale_stream(scans: DataFrame, late: str = "1 day", minutes: int = STALE_MINUTES) -> DataFrame:
    """How scans end, from a stream of (scan_id, status, ts): as they say, or as PARTIAL once the watermark passes ``minutes``
    after they began. The session must name ``PROVIDER``."""
    marked = _dealt(scans.select("scan_id", "status", "ts").withWatermark("ts", late), "scan_id").withColumn("micros", F.unix_micros("ts"))
    ends = marked.groupBy("part").transformWithStateInPandas(StaleScans(minutes), "scan_id long, status string, micros long", "append", "EventTime")
    return ends.select("scan_id", "status", F.timestamp_micros("micros").alias("ts"))


class Cached(StatefulProcessor):
    """The time of the answer that is kept for one key, until a timer drops it."""

    def __init__(self, hours: int):
        self.kept = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        at = self.answer.get()[0] if self.answer.exists() else None
        for ts in pd.concat(list(rows))["ts"].sort_values():
            now = int(ts.timestamp() * 1000)
            hit = at is not None and now - at < self.kept
            at = at if hit else now
            out.append((*key, ts, hit))
        self.answer.update((at,))
        self.handle.registerTimer(at + self.kept)
        yield pd.DataFrame(out, columns=["key", "ts", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.answer.exists() and self.answer.get()[0] + self.kept <= expiredTimerInfo.getExpiryTimeInMs():
            self.answer.clear()
        yield pd.DataFrame([], columns=["key", "ts", "hit"])

    def close(self) -> None:
        pass


def cache_stream(lookups: DataFrame, late: str = "1 day", hours: int = CACHE_HOURS) -> DataFrame:
    """Lookups (key string, ts) with ``hit``: whether an answer to the key is kept that is younger than ``hours`` at that time. A
    miss fetches one. Answers go from the store once the watermark passes their end. The session must name ``PROVIDER``."""
    rows = lookups.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(Cached(hours), "key string, ts timestamp, hit boolean", "append", "EventTime")


def quota_stream(calls: DataFrame, limit: int, late: str = "1 day", length: str = "24 hours") -> DataFrame:
    """Calls of a user and kind in fixed windows, with the limit's flag; late calls count until the watermark passes."""
    w = calls.withWatermark("ts", late).groupBy("user", "kind", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user", "kind", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("exceeded"))


def once(sightings: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first sighting of each key within the watermark."""
    return sightings.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def apply_scans(stream: DataFrame, apply, checkpoint: str):
    """Each micro-batch of sightings goes to ``apply(batch, number)``, which may read and publish state: a batch that is run again writes the same version."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
