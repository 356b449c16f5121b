"""Detectors, normal forms, names and rules on small rows."""

import hashlib
import hmac
import itertools
import random

import pytest
from pyspark.sql import functions as F

from veilscan.functions import detect, names, normalize, rules, text
from veilscan.operators import entities, evaluate, monitor, web
from veilscan.streaming.lifecycle import advance


def column(spark, values, f, kind="string"):
    """f over a column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_emails(spark):
    texts = ["write to A.b+c@Mail.Example.com now", "x@y", "a@b.co, c@d.org", "dot at end a@b.co.", "a..b@c.de", "@x.yz", None, "", "é a@b.cd", "x" * 65 + "@a.bc", "user@-bad.com"]
    got = column(spark, texts, detect.emails)
    assert [[s["raw"] for s in g or []] for g in got] == [["A.b+c@Mail.Example.com"], [], ["a@b.co", "c@d.org"], [], [], [], [], [], ["a@b.cd"], [], []]
    assert got[0][0]["normalized"] == "a.b+c@mail.example.com"
    assert (got[8][0]["start"], got[8][0]["end"]) == (2, 8)


def test_detection_of_long_texts_is_safe_and_linear(spark):
    """Runs that a nested pattern would take apart again and again, and texts of very many matches."""
    import time

    many = lambda n: " ".join(f"n{i}@mail.example.com, 98765{i % 100000:05d};" for i in range(n))
    texts = ["." * 100_000, "a." * 50_000 + "@b.com", "a." * 8000 + "a@b.com", "x@" + "a." * 50_000 + "com", "x@" + "a-" * 50_000, "1 " * 50_000, "(" * 1000 + "+1-" * 30_000, many(5000)]
    got = column(spark, texts, detect.detect)
    assert [len(g) for g in got[:5]] == [0, 0, 0, 0, 0]
    assert len([s for s in got[7] if s["type"] == "EMAIL"]) == len([s for s in got[7] if s["type"] == "PHONE"]) == 5000
    assert all(texts[7][s["start"] : s["end"]] == s["raw"] for s in got[7])
    took = {}
    for n in (2000, 16000):
        began = time.time()
        assert len(column(spark, [many(n)], detect.emails)[0]) == n
        took[n] = time.time() - began
    assert took[16000] < 8 * took[2000] + 3


def test_collisions_are_resolved_as_by_comparing_all(spark):
    rng = random.Random(12)
    for _ in range(6):
        spans = [(rng.choice(["EMAIL", "PHONE", "PAN"]), f"s{i}", f"s{i}", rng.choice([0.4, 0.6, 0.95, 0.95]), ["regex"], a, a + rng.randint(1, 9)) for i in range(rng.choice([0, 1, 2, 40, 300])) for a in [rng.randint(0, 900)]]
        df = spark.createDataFrame([(spans,)], f"found {detect.SPAN}")
        got = df.select(detect.resolved(F.col("found")).alias("r")).first()["r"]
        kept = []
        for s in sorted(spans, key=lambda s: (-s[3], s[5] - s[6], s[5], s[0])):
            if not any(max(k[5], s[5]) < min(k[6], s[6]) for k in kept):
                kept.append(s)
        shape = lambda xs: sorted((x[0], x[5], x[6], x[3]) for x in xs)
        assert shape(map(tuple, got)) == shape(kept)
        assert [g["start"] for g in got] == sorted(g["start"] for g in got)


def test_phones(spark):
    texts = ["+91 98765 43210", "98765-43210", "919876543210", "call 9876543210 8765432109", "+1 (415) 555-2671", "+1 (115) 555-2671", "12345678", "+44 7911 123456", "0 98765 43210"]
    got = column(spark, texts, detect.phones)
    assert [[s["normalized"] for s in g] for g in got] == [["+919876543210"], ["+919876543210"], ["+919876543210"], ["+919876543210", "+918765432109"], ["+14155552671"], [], [], ["+447911123456"], ["+919876543210"]]
    assert got[2][0]["confidence"] == 0.80 and got[0][0]["confidence"] == 0.95
    assert texts[3][got[3][1]["start"] : got[3][1]["end"]] == "8765432109"


def test_check_digits(spark):
    rng = random.Random(7)
    bodies = ["".join(rng.choice("0123456789") for _ in range(11)) for _ in range(300)]
    digits = column(spark, bodies, detect.check_digit)
    every = [b + str(d) for b, own in zip(bodies, digits) for d in range(10)]
    ok = column(spark, every, detect.checksum_ok)
    assert ok == [d == own for own in digits for d in range(10)]
    assert column(spark, ["236", "2363", "x", ""], detect.check_digit)[0] == 3 and column(spark, ["2363", "2364"], detect.checksum_ok) == [True, False]


def test_government_numbers(spark):
    body = "23456789012"
    own = column(spark, [body], detect.check_digit)[0]
    good, bad = f"{body}{own}", f"{body}{(own + 1) % 10}"
    got = column(spark, [f"no {good[:4]} {good[4:8]}-{good[8:]}.", bad, "222222222222", "1" + good[1:], f"9{good}"], detect.aadhaars)
    assert [[(s["confidence"], len(s["provenance"])) for s in g] for g in got] == [[(0.98, 2)], [(0.40, 1)], [], [], []]
    pans = column(spark, ["abcpe1234f", "ABCXE1234F", "ABCPE1234", "xABCPE1234F1"], detect.pans)
    assert [[(s["normalized"], s["confidence"]) for s in g] for g in pans] == [[("ABCPE1234F", 0.95)], [("ABCXE1234F", 0.60)], [], []]


def test_collisions_keep_the_surest(spark):
    body = "91987654321"
    digit = column(spark, [body], detect.check_digit)[0]
    x = f"{body}{digit}"
    got = column(spark, [f"id {x} end", "a@b.co 9876543210"], detect.detect)
    assert [s["type"] for s in got[0]] == ["AADHAAR"]
    assert [s["type"] for s in got[1]] == ["EMAIL", "PHONE"]
    red = column(spark, ["to rahul@x.in or +91 9876543210!", "none"], lambda c: normalize.redacted(c, detect.detect(c)))
    assert red == ["to r***@x.in or +91 •••• 3210!", "none"]


def test_masks(spark):
    assert column(spark, ["rahul@x.in", "ab@x.in", "a@x.in", "bad"], normalize.mask_email) == ["r***@x.in", "a*@x.in", "*@x.in", "••••@••••.com"]
    assert column(spark, ["+919876543210", "+14155552671", "123"], normalize.mask_phone) == ["+91 •••• 3210", "+14 •••• 2671", "••••"]
    assert column(spark, ["2345 6789 0123", "12"], normalize.mask_aadhaar) == ["•••• •••• 0123", "•••• •••• ••••"]
    assert column(spark, ["abcpe1234f", "x"], normalize.mask_pan) == ["ABC•••••4F", "•" * 10]
    assert column(spark, ["a@b.c", "x"], lambda c: normalize.mask_identifier(F.lit("EMAIL"), c)) == ["a***@b.c", "***"]
    assert column(spark, ["abc", "abcdef"], lambda c: normalize.mask_identifier(F.lit("NAME"), c)) == ["••••", "a••••ef"]


def test_identifiers(spark):
    for kind, raw, want in (("EMAIL", " A@B.C ", "a@b.c"), ("PHONE", "+91 98-76", "+919876"), ("USERNAME", "@Neo", "neo"), ("NAME", " A  B ", "a b")):
        assert column(spark, [raw], lambda c: normalize.identifier(F.lit(kind), c)) == [want]


def test_canonical_urls(spark):
    urls = ["http://www.Example.com:80/a/b/?b=2&utm_source=x&a=1&fbclid=3#top", "https://example.com:443", "https://example.com:8443/x/", "ftp://example.com/x", "not a url", "https://example.com/p?id=2&id=1", None]
    assert column(spark, urls, normalize.canonical_url) == ["https://example.com/a/b?a=1&b=2", "https://example.com", "https://example.com:8443/x", None, None, "https://example.com/p?id=2&id=1", None]
    assert column(spark, ["https://www.A.b/c", "x", None], normalize.domain) == ["a.b", "", ""]
    assert column(spark, [" HTTPS://www.a.b:80/x "], normalize.clean_domain) == ["a.b"]
    assert column(spark, ["a.PDF?x", "a.pdfx", "b.pdf#p"], normalize.is_pdf) == [True, False, True]


@pytest.mark.parametrize("key", [b"k", b"k" * 100])
def test_keyed_hash(spark, key):
    values = ["", "abc", "ñ" * 100]
    assert column(spark, values, lambda c: normalize.hmac_sha256(key, c)) == [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values]


def test_fingerprints_normalize(spark):
    f = lambda c: normalize.fingerprint(F.lit(1), F.lit("Web"), F.lit("url"), c)
    a, b, c = column(spark, ["http://www.x.com/a/?utm_id=1", "https://x.com/a", "https://x.com/b"], f)
    assert a == b != c
    assert a == hashlib.sha256("1\0web\0URL\0https://x.com/a".encode()).hexdigest()


def test_query_plan(spark):
    row = spark.createDataFrame([("a-b@c.d", "neo", 'R. "K" site:x', "Org|One")], "m string, u string, n string, o string")
    got = row.select(normalize.query_plan(F.col("m"), F.col("u"), F.col("n"), F.col("o"))).first()[0]
    assert got == ['"a-b@c.d"', '"neo"', '"R. K site x" "a-b@c.d"', '"a-b@c.d" filetype:pdf', '"R. K site x" "Org One"']
    assert column(spark, ["-x ~y a-b", ""], normalize.query_value) == ["x y a-b", ""]


def test_page_text(spark):
    assert column(spark, [None, ""], text.html_to_text) == [None, ""]
    assert column(spark, ["<p>A&nbsp;&lt;b&gt; &#233;&#x1F600;</p><script>x</script><style>y</style> &amp;lt; &copy;"], text.html_to_text) == ["A <b> é😀 &lt; &copy;"]


def test_chunks(spark):
    for n in (0, 1, 121, 1200, 1201, 2400, 30000):
        got = column(spark, ["ab" * (n // 2) + "c" * (n % 2)], lambda c: text.chunks(c, text.WINDOWS))[0]
        want, at = [], 0
        while len(want) < 20:
            want.append(at)
            if at + 1200 >= n:
                break
            at += 1080
        assert [c["start"] for c in got] == want, n
    assert column(spark, ["a😀b"], lambda c: text.utf16_offset(c, F.lit(2))) == [3]


def test_chunks_of_whole_texts(spark):
    for n in (0, 1, 121, 1200, 1201, 21720, 21721, 128657):
        long = "".join(chr(97 + i * i % 25) for i in range(n))
        whole = column(spark, [long], text.chunks)[0]
        assert "".join(c["text"] if i == 0 else c["text"][120:] for i, c in enumerate(whole)) == long
        assert not any(c["partial"] for c in whole)
        cut = column(spark, [long], lambda c: text.chunks(c, text.WINDOWS))[0]
        assert [c["text"] for c in cut] == [c["text"] for c in whole[:20]]
        assert {c["partial"] for c in cut} == {n > 21720}


def test_name_tokens(spark):
    got = column(spark, ["Dr. R. K. Sharma-Patel", "Dr", "José  Ñandú", None, "", "Mr. O'Neil"], names.tokens)
    assert got == [["r", "k", "sharma", "patel"], ["dr"], ["jose", "nandu"], [], [], ["oneil"]]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Rahul Kumar", "rahul KUMAR", (1.0, True, "EXACT")),
        ("R. Kumar", "Rahul Kumar", (0.93, True, "INITIALS_EXPANSION")),
        ("Kumar", "Rahul Kumar", (0.5, True, "PARTIAL")),
        ("R", "Rahul Kumar", (0.43, False, "NO_MATCH")),
        ("Rahul Verma", "Rahul Kumar", (0.5, False, "NO_MATCH")),
        ("", "Rahul", (0.0, False, "NO_MATCH")),
        ("Rahul Rahul", "Rahul R", (0.93, True, "INITIALS_EXPANSION")),
    ],
)
def test_compare_names(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    got = row.select(names.compare(names.tokens(F.col("a")), names.tokens(F.col("b"))).alias("m")).first()["m"]
    assert tuple(got) == want


def test_unmatched_tokens_are_by_place(spark):
    rows = [("Rahul Rahul Sen", "Rahul Kumar"), ("R. Kumar", "Rahul Kumar"), ("", "Asha"), ("Asha Sen", "Asha Sen")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = df.select("i", names.unmatched(names.tokens(F.col("a")), names.tokens(F.col("b"))).alias("m")).orderBy("i").collect()
    assert [(r["m"]["a"], r["m"]["b"]) for r in got] == [(["rahul", "sen"], ["kumar"]), ([], []), ([], ["asha"]), ([], [])]


def test_blocked_names_are_all_matches(spark):
    rng = random.Random(3)
    pool = ["Rahul", "R.", "Kumar", "K", "Asha", "A", "Sen", "Dr.", "S"]
    people = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    df = spark.createDataFrame(people, "id long, name string")
    got = {tuple(r) for r in names.matches(df, df, "id", "name", "id", "name").collect()}
    both = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.id"), F.col("b.id"), names.compare(names.tokens(F.col("a.name")), names.tokens(F.col("b.name"))).alias("m")).filter("m.is_match")
    assert got == {(r[0], r[1], r["m"]["similarity"], r["m"]["match_type"]) for r in both.collect()}


def test_common_names(spark):
    assert column(spark, ["Rahul Kumar", "Rahul Zed", "Kumar", "R K", "Zed"], lambda c: names.is_common(names.tokens(c))) == [True, False, True, False, False]


def test_confidence_extremes(spark):
    flags = ["email", "phone", "username", "attested", "name", "org", "location"]
    cases = {("email", "org", "location"): (0.98, "CONFIRMED"), ("attested", "org", "location"): (0.73, "POTENTIAL"), ("attested", "name", "org", "location"): (0.5, "CONFIRMED"), ("name", "org", "location"): (0.43, "CONFIRMED"), (): (0.13, "POTENTIAL"), ("username",): (0.85, "CONFIRMED")}
    for on, want in cases.items():
        row = spark.range(1).select(rules.identity_confidence(*[F.lit(f in on) for f in flags], F.lit(2), F.lit(False)).alias("c")).first()["c"]
        if not on:
            want = (0.05, "POTENTIAL")
        assert (row["confidence"], row["match_label"]) == want, on


def test_addresses(spark):
    ips = ["10.1.2.3", "100.63.0.1", "100.64.0.1", "169.254.169.254", "172.15.0.1", "172.31.0.1", "192.168.0.1", "8.8.8.8", "256.1.1.1", "x", "::1", "fe80::1", "fd00::1", "64:ff9b::1", "::ffff:8.8.8.8", "2001:4860::8888", None]
    got = {r["ip"]: r["blocked"] for r in web.screened(spark.createDataFrame([(i,) for i in ips], "ip string")).collect()}
    assert [got[i] for i in ips] == [True, False, True, True, False, True, True, False, True, True, True, True, True, True, False, False, True]
    hosts = spark.createDataFrame([("a", ["8.8.8.8", "10.0.0.1"]), ("b", ["8.8.8.8"]), ("c", [])], "host string, addresses array<string>")
    assert {r["host"]: r["blocked"] for r in web.hosts_blocked(hosts).collect()} == {"a": True, "b": False, "c": True}


def test_brokers(spark):
    catalog = spark.createDataFrame([("A", "a.com", "o1", ["x.org"], 0), ("B", "b.a.com", "o2", [], 1)], "name string, domain string, opt_out_url string, domains array<string>, position int")
    hosts = spark.createDataFrame([("b.a.com",), ("c.b.a.com",), ("za.com",), ("p.x.org",)], "host string")
    assert {r["host"]: r["broker"] for r in web.broker_match(hosts, catalog).collect()} == {"b.a.com": "B", "c.b.a.com": "A"}
    assert {r["host"]: r["broker"] for r in web.broker_match(hosts, catalog, aliases=True).collect()} == {"b.a.com": "A", "c.b.a.com": "A", "p.x.org": "A"}


def test_all_histories(spark):
    """The closed form is the step function, for every history of sightings."""
    rows, want = [], {}
    for n in range(1, 9):
        for h in itertools.product([True, False], repeat=n - 1):
            history = (True, *h)
            key, state, absences = "".join("01"[x] for x in history), None, 0
            for i, seen in enumerate(history):
                rows.append((1, "s", key, i, seen))
                state, absences, _ = advance(state, absences, seen, False)
                want[key, i] = (state, absences)
    grid = spark.createDataFrame(rows, "identity long, source string, entity string, scan int, seen boolean")
    got = {(r["entity"], r["scan"]): (r["state"], r["absences"]) for r in monitor.lifecycle(grid).collect()}
    # a closed finding stays closed; its count starts anew in the step function
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == v[1] for k, v in want.items() if v[0] != "CLOSED")


def test_steps_are_the_same_in_both_forms(spark):
    states = [None, "FIRST_SEEN", "ACTIVE", "UNCHANGED", "NOT_FOUND", "REAPPEARED", "REMEDIATED", "CLOSED"]
    rows = [(s, n, seen, marked) for s in states for n in (0, 1, 2) for seen in (True, False) for marked in (True, False)]
    df = spark.createDataFrame(rows, "s string, n int, seen boolean, marked boolean")
    got = df.select("*", monitor.step(F.col("s"), F.col("n"), F.col("seen"), F.col("marked")).alias("t")).collect()
    assert all(tuple(r["t"]) == advance(r["s"], r["n"], r["seen"], r["marked"]) for r in got)


def test_apply_scan(spark):
    kind = "identity long, source string, entity string, state string, absences int, severity string, first_scan int, last_scan int"
    stored = spark.createDataFrame([(1, "a", "x", "UNCHANGED", 0, "LOW", 0, 1), (1, "a", "y", "NOT_FOUND", 2, "HIGH", 0, 0), (1, "b", "z", "ACTIVE", 0, "LOW", 0, 1), (1, "a", "w", "CLOSED", 3, "HIGH", 0, 0)], kind)
    seen = spark.createDataFrame([(1, "a", "x", "snippet", 1, "HIGH"), (1, "a", "n", "document", 2, "MEDIUM"), (1, "a", "w", "snippet", 3, "LOW")], "identity long, source string, entity string, tier string, position int, severity string")
    ran = spark.createDataFrame([(1, "a", 2)], "identity long, source string, scan int")
    got = {r["entity"]: (r["state"], r["absences"], r["severity"], r["change"]) for r in monitor.apply_scan(stored, seen, ran, F.lit(2)).collect()}
    assert got == {"x": ("UNCHANGED", 0, "LOW", "updated"), "y": ("CLOSED", 3, "HIGH", "closed"), "z": ("ACTIVE", 0, "LOW", None), "n": ("FIRST_SEEN", 0, "MEDIUM", "created"), "w": ("REAPPEARED", 0, "CRITICAL", "reappeared")}


def test_recognized_spans(spark):
    rows = [(1, "person", "Ann", 0.9, 0, 3), (1, "person", "Ann ", 0.8, 0, 4), (1, "person", "Bob", 0.3, 5, 8), (1, "alien", "Z", 0.9, 9, 10), (1, "org", "Ann", 0.5, 0, 3), (1, "person", "Far", 0.5, 50, 60), (1, "city", "NaN", float("nan"), 5, 8)]
    df = spark.createDataFrame([(*r, 20) for r in rows], "doc_id long, label string, text string, score double, start int, end int, n_chars int")
    kept = entities.deduplicated(entities.recognized(df)).collect()
    assert sorted((r["label"], r["text"]) for r in kept) == [("org", "Ann"), ("person", "Ann")]
    chunk = spark.createDataFrame([(1, 100, "see Ann here")], "doc_id long, start int, text string")
    predict = lambda t, labels, threshold: [{"label": labels[0], "text": "Ann", "score": 0.7, "start": t.index("Ann"), "end": t.index("Ann") + 3}]
    r = entities.recognize(chunk, predict, ["person"]).first()
    assert (r["start"], r["end"]) == (104, 107)


def test_fusion(spark):
    found = spark.createDataFrame([(1, "EMAIL", "a@b.co", "a@b.co", 0.95, 10, 16)], "doc_id long, type string, raw string, normalized string, confidence double, start int, end int")
    ner = spark.createDataFrame([(1, "EMAIL", "a@b", 0.6, 10, 13), (1, "EMAIL", "b.co", 0.7, 12, 16), (1, "PERSON", "a", 0.8, 10, 11), (1, "PERSON", "by a", 0.8, 8, 12), (1, "PERSON", "by a", 0.8, 8, 12)], "doc_id long, type string, text string, score double, start int, end int")
    got = sorted((r["type"], r["detector"], r["ner_score"], r["start"]) for r in entities.fuse(found, ner).collect())
    assert got == [("EMAIL", "fused", 0.7, 10), ("PERSON", "ner", 0.8, 8)]


def test_precision_recall(spark):
    a = spark.createDataFrame([("E", 1), ("E", 2), ("P", 1)], "type string, k int")
    b = spark.createDataFrame([("E", 2), ("E", 3), ("E", 4)], "type string, k int")
    got = {r["type"]: tuple(r)[1:] for r in evaluate.precision_recall(a, b, ["k"], "type").collect()}
    assert got["E"][:3] == (1, 1, 2) and got["E"][5] == pytest.approx(0.4) and got["P"] == (0, 1, 0, 0.0, 0.0, 0.0)
