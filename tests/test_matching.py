"""Joins by longest prefix, rarest token, position and anchor against plain loops, with hot keys."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from veilscan.functions import names
from veilscan.operators import prefix, spans, web


def test_addresses_in_every_spelling(spark):
    rng = random.Random(1)
    known = []
    for _ in range(600):
        n = rng.getrandbits(128) & rng.choice([(1 << 128) - 1, 0xFFFF << 112 | 0xFFFF, 0xFFFF])
        a = ipaddress.IPv6Address(n)
        known += [(a.compressed, f"{n:032x}"), (a.exploded.upper(), f"{n:032x}"), (f"[{a.compressed}]", f"{n:032x}")]
        v4 = ipaddress.IPv4Address(rng.getrandbits(32))
        mapped = f"{'0' * 20}ffff{int(v4):08x}"
        known += [(str(v4), mapped), (f"::ffff:{v4}", mapped), (f"0:0:0:0:0:ffff:{v4}", mapped), (f" {v4} ", mapped)]
    bad = ["", "x", ":", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8::", "::12345", "1.2.3", "1.2.3.4.5", "256.1.1.1", "::1.2.3.400", "1:2:3:4:5:6:7:1.2.3.4", "g::", None, "1.2.3.4:80"]
    rows = known + [(b, None) for b in bad]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", prefix.address(F.col("a")).alias("d")).collect()
    assert {r["i"]: r["d"] for r in got} == {i: w for i, (_, w) in enumerate(rows)}


def test_longest_prefix_is_that_of_a_loop(spark):
    rng = random.Random(2)
    nets, base = {}, [rng.getrandbits(32) for _ in range(50)]
    while len(nets) < 10_000:
        n = rng.randint(4, 32)
        value = (rng.choice(base) ^ rng.getrandbits(rng.randint(0, 20))) >> (32 - n) << (32 - n)
        nets[(n, value)] = len(nets)
    v6 = {(n + 96, f"{(0xFFFF << 32) | v:032x}"[: -(-(n + 96) // 4)]): i for (n, v), i in nets.items()}
    for (n, v), i in list(nets.items())[:200]:
        assert prefix.network(f"{ipaddress.IPv4Address(v)}/{n}") in v6
    addresses = [rng.choice(base) ^ rng.getrandbits(rng.randint(0, 24)) for _ in range(2000)]
    addresses += [addresses[0]] * 1000  # a third of all rows has one key
    rows = [(i, str(ipaddress.IPv4Address(a))) for i, a in enumerate(addresses)] + [(-1, "nonsense"), (-2, None)]
    table = spark.createDataFrame([(n, p, i, "clash") for (n, p), i in v6.items()], "length int, prefix string, net int, ip2 string")
    got = prefix.longest(spark.createDataFrame(rows, "id int, ip string").withColumn("key", prefix.address(F.col("ip"))), "key", table)
    want = {-1: None, -2: None}
    for i, a in enumerate(addresses):
        want[i] = next((nets[n, a >> (32 - n) << (32 - n)] for n in range(32, 3, -1) if (n, a >> (32 - n) << (32 - n)) in nets), None)
    assert {r["id"]: r["net"] for r in got.collect()} == want
    assert prefix.longest(spark.createDataFrame(rows, "id int, ip string"), "ip", table.limit(0)).filter("net is not null").count() == 0
    digits = spark.createDataFrame([("4420", "London"), ("44", "UK"), ("1", "NANP"), ("442", "x")], "prefix string, area string").withColumn("length", F.length("prefix"))
    numbers = spark.createDataFrame([("4420123",), ("4421",), ("44",), ("999",), ("1",), (None,), ("",)], "n string")
    assert {r["n"]: r["area"] for r in prefix.longest(numbers, "n", digits, prefix.leading).collect()} == {"4420123": "London", "4421": "x", "44": "UK", "999": None, "1": "NANP", None: None, "": None}


def test_blocked_networks_are_those_of_a_loop(spark):
    from veilscan.sources.dims import BLOCKED_RANGES, BLOCKED_RANGES_V6

    rng = random.Random(3)
    nets = [ipaddress.ip_network(c) for c in BLOCKED_RANGES + BLOCKED_RANGES_V6]
    some = [n[0] + d for n in nets for d in (0, 1, n.num_addresses - 1)] + [n[0] - 1 for n in nets if int(n[0])] + [n[-1] + 1 for n in nets if int(n[-1]) + 1 < 1 << n.max_prefixlen]
    some += [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(200)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(200)]

    def blocked(a):
        a = getattr(a, "ipv4_mapped", None) or a
        return any(a.version == n.version and a in n for n in nets)

    got = web.screened(spark.createDataFrame([(str(a),) for a in some], "ip string")).collect()
    assert {r["ip"]: r["blocked"] for r in got} == {str(a): blocked(a) for a in some}


def test_names_by_rarest_tokens_are_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = ["kumar", "ann", "anna", "bo", "carl", "dee", "eve", "finn", "a", "k", "e"]
    made = lambda n: [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 2, 3, 4, 5])))) for i in range(n)]
    left, right = made(90) + [(900, None), (901, "Dr. Ann Kumar"), (902, "ann kumar")], made(80) + [(800, "K. Ann")]
    a, b = spark.createDataFrame(left, "id long, name string"), spark.createDataFrame(right, "id long, name string")
    got = {(r["left_id"], r["right_id"]): (r["similarity"], r["match_type"]) for r in names.matches(a, b, "id", "name", "id", "name").collect()}
    pairs = a.select(F.col("id").alias("i"), names.tokens(F.col("name")).alias("x")).crossJoin(b.select(F.col("id").alias("j"), names.tokens(F.col("name")).alias("y")))
    want = {(r["i"], r["j"]): (r["m"]["similarity"], r["m"]["match_type"]) for r in pairs.select("i", "j", names.compare(F.col("x"), F.col("y")).alias("m")).filter("m.is_match").collect()}
    assert got == want and len(want) > 100


def test_a_token_of_a_third_of_all_names_makes_no_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT", 50)
    seen = []
    monkeypatch.setattr(names, "compare", lambda a, b, own=names.compare: seen.append(1) or own(a, b))
    left = [(i, f"first{i} " + ("kumar" if i % 3 == 0 else f"last{i}")) for i in range(600)]
    right = [(i, f"first{i} " + ("kumar" if i % 3 == 0 else f"last{i}")) for i in range(600)] + [(1000, "kumar")]
    a, b = spark.createDataFrame(left, "id long, name string"), spark.createDataFrame(right, "id long, name string")
    lists = lambda df, side: df.select(names.tokens(F.col("name")).alias(f"{side}_tokens")).distinct()
    candidates = names._looked_up(lists(a, "left"), lists(b, "right"), "left_tokens", "right_tokens", F.lit(1), F.lit(True)).count()
    assert candidates <= 700  # all pairs of that token would be 40,000
    got = {(r["left_id"], r["right_id"]) for r in names.matches(a, b, "id", "name", "id", "name").collect()}
    assert got == {(i, i) for i in range(600)} | {(i, 1000) for i in range(0, 600, 3)}


SPAN = "doc_id long, label string, score double, start int, end int"


def test_overlaps_are_those_of_a_loop(spark):
    rng = random.Random(5)
    made = lambda n: [(rng.choice([1, 1, 2, None]), rng.choice("xy"), rng.random(), s := rng.randint(0, 300), s + rng.choice([0, 1, 2, 5, 40, 200])) for _ in range(n)]
    left, right = made(150), made(120)
    got = spans.overlapping(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), ["doc_id"])
    got = sorted((r["l_start"], r["l_end"], r["l_score"], r["r_start"], r["r_end"], r["r_score"]) for r in got.collect())
    want = sorted((a[3], a[4], a[2], b[3], b[4], b[2]) for a in left for b in right if a[0] == b[0] and a[0] is not None and max(a[3], b[3]) < min(a[4], b[4]))
    assert got == want


def test_many_overlaps_in_one_document(spark):
    n = 100_000
    a = spark.range(n).selectExpr("1L as doc_id", "cast(id * 10 as int) as start", "cast(id * 10 + 7 as int) as end")
    b = spark.range(n).selectExpr("1L as doc_id", "cast(id * 10 + 5 as int) as start", "cast(id * 10 + 12 as int) as end")
    began = time.time()
    assert spans.overlapping(a, b, ["doc_id"]).count() == 2 * n - 1
    assert time.time() - began < 60


@pytest.mark.parametrize("kind", ["mixed", "chain", "copies"])
def test_greedy_choice_is_that_of_a_loop(spark, kind):
    rng = random.Random(6)
    if kind == "chain":  # each span is beaten by the one before it: nothing for rounds
        rows = [(1, "x", 1 - i / 1000, 4 * i, 4 * i + 10) for i in range(300)]
    elif kind == "copies":
        rows = [(1, "x", rng.random(), 5, 15) for _ in range(500)] + [(1, "x", 0.5, 6, 16)]
    else:
        rows = [(rng.choice([1, 2]), rng.choice("xy"), rng.choice([0.5, 0.6, 0.7]), s := rng.randint(0, 80), s + rng.randint(1, 20)) for _ in range(400)]
    iou = lambda a, b: (max(0, min(a[4], b[4]) - max(a[3], b[3]))) / (max(a[4], b[4]) - min(a[3], b[3]) if min(a[4], b[4]) > max(a[3], b[3]) else 1)
    want = []
    for r in sorted(rows, key=lambda r: (-r[2], r[3], r[4])):
        if not any(k[0] == r[0] and k[1] == r[1] and iou(k, r) >= 0.5 for k in want):
            want.append(r)
    from veilscan.operators.entities import deduplicated

    df = spark.createDataFrame(rows, SPAN).withColumn("text", F.lit("t"))
    got = deduplicated(df).select("doc_id", "label", "score", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pairs_of_one_name_are_spread_over_tasks(spark):
    a = spark.range(1500).select("id", F.lit("Zora Quill").alias("name"))
    b = spark.range(1500).select((F.col("id") + 5000).alias("id"), F.when(F.col("id") == 7, "Nobody Else").otherwise("Z. Quill").alias("name"))
    got = names.matches(a, b, "id", "name", "id", "name").withColumn("task", F.spark_partition_id())
    tasks = got.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("left_id", "right_id").alias("d"), F.min("right_id").alias("least"), F.max("right_id").alias("most")).collect()
    assert sum(r["n"] for r in tasks) == sum(r["d"] for r in tasks) == 1500 * 1499
    assert max(r["n"] for r in tasks) < 1500 * 1499 / 2



def test_best_name_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    first, last = ["zoe", "z", "max", "m", "mara"], ["quill", "q", "quist", "west"]
    made = lambda n: [(rng.randrange(n // 2), " ".join([rng.choice(first), rng.choice(last)][: rng.choice([1, 2, 2, 2])])) for _ in range(n)]
    a, b = (spark.createDataFrame(made(120), "id long, name string") for _ in "ab")
    want = {}
    for r in names.matches(a, b, "id", "name", "id", "name").collect():
        want[r["left_id"]] = min(want.get(r["left_id"], (0.0, 0)), (-r["similarity"], r["right_id"]))
    got = {r["left_id"]: (-r["similarity"], r["right_id"]) for r in names.best(a, b, "id", "name", "id", "name").collect()}
    assert got == want and len(want) > 20
