"""Streams that stop and go on, a sink that commits as a whole, containment and the automaton against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilscan.operators import contain, discovery
from veilscan.plans.monitoring import _stateful
from veilscan.sources import committed, records
from veilscan.streaming import lifecycle as S


def answer(n):
    return json.dumps({"searches": [{"person_id": f"p{n}", "query": f"q{n}", "results": [{"url": f"http://{n}", "snippet": "s"}, {"url": None}, {"title": "t", "url": f"http://{n}/2"}]}, {"query": "none"}]})


def test_recorded_searches_stream_goes_on_after_a_stop(spark, tmp_path):
    spark.dataSource.register(records.RecordedSearch)
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()

    def run():
        rows = spark.readStream.format("recorded_search").load(str(source))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r["url"] for r in spark.read.parquet(out).collect())

    want = []
    for first in (0, 5, 6):
        for n in range(first, first + (5 if first == 0 else 1)):
            (source / f"{9 - n}.json").write_text(answer(n))  # names go backwards: order is that of time
            want += [f"http://{n}", f"http://{n}/2"]
        assert run() == sorted(want)
    assert run() == sorted(want)
    assert {(r["person_id"], r["snippet"]) for r in spark.read.parquet(out).filter("position = 1").collect()} == {(f"p{n}", "s") for n in range(7)}


def test_lifecycle_goes_on_from_stored_findings_and_after_a_stop(spark, tmp_path):
    own = _stateful(spark)
    ticks, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    stored = own.createDataFrame([(1, "s", "old", "NOT_FOUND", 2, 4)], "identity long, source string, entity string, state string, absences int, last int")
    schema = "identity long, source string, entity string, scan int, seen boolean, marked boolean"

    def add(rows):
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ticks)
        stream = own.readStream.schema(schema).parquet(ticks)
        S.lifecycle_stream(stream, stored).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return {(r["entity"], r["scan"]): (r["state"], r["absences"]) for r in own.read.parquet(out).collect()}

    got = add([(1, "s", "old", 4, True, False), (1, "s", "old", 5, False, False), (1, "s", "new", 5, True, False)])
    assert got == {("old", 5): ("CLOSED", 3), ("new", 5): ("FIRST_SEEN", 0)}
    got = add([(1, "s", "old", 6, True, False), (1, "s", "new", 6, True, False), (1, "s", "new", 5, False, False)])
    assert got == {("old", 5): ("CLOSED", 3), ("new", 5): ("FIRST_SEEN", 0), ("old", 6): ("REAPPEARED", 0), ("new", 6): ("ACTIVE", 0)}


def test_stale_scans(spark, tmp_path):
    own = _stateful(spark)
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"

    def run(name, make, rows, schema):
        source, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        own.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = own.readStream.schema(own.read.parquet(source).schema).parquet(source)
        make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in own.read.parquet(out).collect()]

    scans = "scan_id long, status string, ts string"
    stale = lambda s: S.stale_stream(s, "0 seconds")
    got = run("scans", stale, [(1, "QUEUED", at(0)), (2, "RUNNING", at(1)), (3, "RUNNING", at(2)), (3, "COMPLETED", at(5)), (4, "QUEUED", at(4))], scans)
    assert {x[:2] for x in got} == {(3, "COMPLETED")}
    got = run("scans", stale, [(4, "RUNNING", at(9)), (5, "QUEUED", at(12))], scans)
    assert {x[:2] for x in got} == {(3, "COMPLETED"), (1, "PARTIAL"), (2, "PARTIAL")}  # 4 counts from when it ran
    got = run("scans", stale, [(9, "QUEUED", at(30))], scans)
    assert {x[:2] for x in got} == {(3, "COMPLETED"), (1, "PARTIAL"), (2, "PARTIAL"), (4, "PARTIAL"), (5, "PARTIAL")}


def test_kept_answers(spark, tmp_path):
    own = _stateful(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        df = own.createDataFrame([(k, f"2024-01-{1 + m // 1440:02d} {m // 60 % 24:02d}:{m % 60:02d}:00") for k, m in rows], "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        S.cache_stream(own.readStream.schema(df.schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["key"], r["ts"].day * 1440 + r["ts"].hour * 60 + r["ts"].minute - 1440, r["hit"]) for r in own.read.parquet(out).collect())

    first = [("a", 0, False), ("a", 100, True), ("a", 359, True), ("a", 360, False), ("a", 400, True), ("b", 5, False)]
    assert run([(k, m) for k, m, _ in first]) == first
    later = [("a", 700, True), ("a", 800, False), ("b", 3000, False)]
    assert run([(k, m) for k, m, _ in later]) == sorted(first + later)


def test_a_commit_is_whole_or_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int, bucket int"
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k string, v int")
    now = lambda: {r["k"]: r["v"] for r in committed.read(spark, path, spark.createDataFrame([], schema).schema).collect()}
    merge = lambda old, new: new.unionByName(old.drop("bucket").join(new, "k", "left_anti").select("k", "v")) if "bucket" in old.columns else new.unionByName(old.join(new, "k", "left_anti").select("k", "v"))
    assert committed.latest(path)["version"] == 0
    committed.upsert(rows([f"k{i}" for i in range(200)], 1), path, "k", merge, 8, "b1")
    first = committed.latest(path)
    assert len(now()) == 200 and set(now().values()) == {1} and len({f[0] for f in first["files"]}) == 8
    committed.upsert(rows(["k1", "new"], 2), path, "k", merge, 8, "b2")
    second = committed.latest(path)
    touched = {f[0] for f in second["files"] if f not in first["files"]}
    assert len(now()) == 201 and now()["k1"] == now()["new"] == 2 and now()["k2"] == 1 and 1 <= len(touched) <= 2
    assert {tuple(f) for f in first["files"] if f[0] not in touched} <= {tuple(f) for f in second["files"]}
    committed.upsert(rows(["k1"], 3), path, "k", merge, 8, "b2")  # run again: one version
    assert committed.latest(path) == second
    committed.write(rows(["k1"], 3), path, "k", 8, "b2", "all")
    assert committed.latest(path) == second

    broken = spark.createDataFrame([(f"x{i}", i) for i in range(100)], "k string, v int").repartition(4).withColumn("v", F.when(F.col("v") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        committed.write(broken, path, "k", 8)
    assert committed.latest(path) == second and len(now()) == 201


def test_containment_is_that_of_a_loop(spark, monkeypatch):
    monkeypatch.setattr(contain, "HOT", 20)
    rng = random.Random(7)
    made = lambda n, most: ["".join(rng.choice("abc é") for _ in range(rng.randint(0, most))) for _ in range(n)] + [None, "", "the hot word"]
    inner = made(120, 6)
    outer = made(120, 25) + [f"the hot word {i}" for i in range(100)] + ["😀abc😀"]
    a, b = spark.createDataFrame([(x,) for x in inner], "x string"), spark.createDataFrame([(y,) for y in outer], "y string")
    got = {(r["x"], r["y"]) for r in contain.containing(a, b, "x", "y").collect()}
    assert got == {(x, y) for x in inner for y in outer if x and y and x in y}
    assert contain.containing(a.limit(0), b, "x", "y").count() == 0


def test_recorded_answers_by_parts_of_words(spark):
    planned = [('"Ann Lee" x',), ("board",), ("hot",), ("nothing",), ("equal one",)]
    recorded = [(5, "ann  lee x y"), (3, "skateboarding"), (4, "boar"), (7, "equal one"), (1, "equal one two"), (9, "a hot day"), (8, "hot days")]
    got = discovery.recorded_answers(spark.createDataFrame(planned, "query string"), spark.createDataFrame(recorded, "recorded_id int, query string")).collect()
    assert {(r["query"], r["recorded_id"]) for r in got} == {('"Ann Lee" x', 5), ("board", 3), ("hot", 8), ("equal one", 7)}


@pytest.mark.parametrize("most", [1000, 3])
def test_gazetteer_is_that_of_a_loop(spark, most):
    rng = random.Random(8)
    vocabulary = ["new", "york", "city", "ann", "bée", "o"]
    values = [("T", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4)))) for _ in range(25)] + [("U", "New  York"), ("U", "-"), ("U", None), ("U", " Ann ")]
    texts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(30)).title()) for i in range(40)] + [(99, None), (98, "")]
    got = contain.gazetted(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(values, "type string, value string"), most)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def inside(v, t):
        return bool(words(v)) and f" {' '.join(words(v))} " in f" {' '.join(words(t))} "

    want = {(d, k, v.strip()) for d, t in texts if t for k, v in values if v and inside(v, t)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


class Store:
    """A state store for one part that counts what it is asked."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getValueState", "getMapState"):
                return self
            if name == "get":
                return self.value
            if name == "exists":
                return bool(self.map)
            if name == "getValue":
                return self.map.get(args[0])
            if name == "updateValue":
                self.map[args[0]] = args[1]
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            if name == "registerTimer":
                self.timers.add(args[0])
            if name == "deleteTimer":
                self.timers.remove(args[0])

        return call


class Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_many_findings_of_a_part_cost_the_store_two_calls_an_owner():
    import pandas as pd

    rng, store, run = random.Random(5), Store(), S.Lifecycle()
    run.init(store)
    stored = [(i, "s", f"e{e}", "NOT_FOUND", 1, 2) for i in range(5) for e in range(0, 100, 2)]
    now = {r[:3]: r[3:] for r in stored}
    frame = pd.DataFrame(stored, columns=["identity", "source", "entity", "state", "absences", "last"])
    for piece in (frame[:30], frame[30:]):
        run.handleInitialState((0,), piece, Times(0))
    got, want = [], []
    for batch in range(4):
        rows = [(i, s, f"e{e}", scan, rng.random() < 0.4, rng.random() < 0.1) for i in range(6) for s in "st" for e in range(100) for scan in range(batch * 3, batch * 3 + 4)]  # the first scan of a batch comes again
        rng.shuffle(rows)
        for row in sorted(rows, key=lambda r: r[3]):
            state, absences, last = now.get(row[:3], (None, 0, -1))
            if row[3] > last and (state is not None or row[4]):
                state, absences, _ = S.advance(state, absences, row[4], row[5])
                now[row[:3]] = (state, absences, row[3])
                want.append((*row[:4], state, absences))
        before = store.calls
        frame = pd.DataFrame(rows, columns=["identity", "source", "entity", "scan", "seen", "marked"])
        got += [tuple(x) for f in run.handleInputRows((0,), iter([frame[:999], frame[999:]]), Times(0)) for x in f.itertuples(index=False)]
        assert store.calls - before <= 2 * 12 + 1
    assert sorted(got) == sorted(want) and len(got) > 10_000


def test_many_scans_of_a_part_cost_the_store_a_few_calls():
    import pandas as pd

    rng, store, run = random.Random(4), Store(), S.StaleScans(10)
    run.init(store)
    since, got, want = {}, [], []
    for batch in range(5):
        rows = [(rng.randrange(1000), rng.choice(["QUEUED", "RUNNING", "COMPLETED", "FAILED"]), (batch * 600_000 + rng.randrange(600_000)) * 1000 + 7) for _ in range(800)]
        for scan in {r[0] for r in rows}:  # one scan after another, as its rows say
            own = [r for r in rows if r[0] == scan]
            ended = sorted((r[2], r[1]) for r in own if r[1] in ("COMPLETED", "FAILED"))
            if ended:
                since.pop(scan, None)
                want.append((scan, ended[0][1], ended[0][0]))
            elif running := [r[2] for r in own if r[1] == "RUNNING"]:
                since[scan] = min(running) // 1000
            else:
                since.setdefault(scan, min(r[2] for r in own) // 1000)
        before = store.calls
        frame = pd.DataFrame(rows, columns=["scan_id", "status", "micros"])
        got += [tuple(x) for f in run.handleInputRows((0,), iter([frame[:300], frame[300:]]), Times(0)) for x in f.itertuples(index=False)]
        mark = batch * 600_000 + 300_000
        for timer in [t for t in store.timers if t <= mark]:
            store.timers.remove(timer)
            got += [tuple(x) for f in run.handleExpiredTimer((0,), Times(mark), Times(timer)) for x in f.itertuples(index=False)]
        assert store.calls - before < 12 and len(store.timers) <= 1
        want += [(s, "PARTIAL", (at + 600_000) * 1000) for s, at in since.items() if at + 600_000 <= mark]
        since = {s: at for s, at in since.items() if at + 600_000 > mark}
    assert sorted(got) == sorted(want) and sum(r[1] == "PARTIAL" for r in got) > 100
    assert store.value[2] == min(store.timers) == min(since.values()) + 600_000
