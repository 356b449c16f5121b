"""Registered queries against their SQL, and recorded sources."""

import glob
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilscan.functions import detect, normalize
from veilscan.operators import evaluate
from veilscan.plans import catalog
from veilscan.sources import records
from veilscan.sources.dims import NUMBER_PLANS

DATA = "/root/testdata/sf0.001"


def rows(table):
    df = table.to_pandas()
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v != v:
            return "~"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, db, name):
    got = catalog.queries()[name](spark, DATA).toArrow()
    want = db.execute(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_long_texts_are_chunked_whole(spark, tmp_path):
    texts = [(1, "aé😀" * 12000), (2, "x" * 21721), (3, ""), (4, None), (5, "short")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()["doc_chunks_whole"](spark, str(tmp_path)).toArrow()
    assert rows(got) == rows(c.execute(catalog.oracle_sql()["doc_chunks_whole"]).to_arrow_table())
    last = {d: max(s + len(x) for e, s, x in zip(*(got[n].to_pylist() for n in ("doc_id", "start", "chunk"))) if e == d) for d in (1, 2, 3, 5)}
    assert last == {1: 36000, 2: 21721, 3: 0, 5: 5}


def test_identities_are_correlated_by_all_signals(spark, tmp_path):
    customers = spark.createDataFrame([(k, k % 3, ("BUILDING", "MACHINERY")[k % 2]) for k in range(1, 61)], "c_custkey long, c_nationkey long, c_mktsegment string")
    nations = spark.createDataFrame([(0, "SAUDI ARABIA"), (1, "PERU"), (2, "CHINA")], "n_nationkey long, n_name string")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    nations.write.parquet(f"{tmp_path}/nation.parquet")
    from veilscan.plans import identity

    who = {r["identity_id"]: r for r in identity.identities(spark, str(tmp_path)).collect()}
    mail, phone, name = (lambda k: who[k]["email"].strip().lower()), (lambda k: who[k]["phone"]), (lambda k: who[k]["name"])
    first, last = name(9).split()
    texts = {
        1: f"Write to {mail(4)} now.",
        2: f"Call {phone(6)} or {phone(7)}, in Saudi  Arabia.",
        3: f"{name(5).upper()} works here.",
        4: f"{name(8)}, machinery and building, China",
        5: f"Mr. {first[0]}. {last} of peru",
        6: f"{mail(10)} {phone(10)} {name(10)} Building",
        7: "Building in Peru, nobody named",
        8: None,
    }
    docs = spark.createDataFrame([(d, "s", "en", t) for d, t in texts.items()], "doc_id long, source string, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, t in texts.items():
        words = [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        says = lambda x: f" {x.lower()} " in f" {' '.join(words)} "  # noqa: E731, B023
        org, loc = {x for x in ("building", "machinery") if says(x)}, {x for x in ("saudi arabia", "peru", "china") if says(x)}
        for k, i in who.items():
            f, n = i["name"].split()
            s = {"email": mail(k) in (t or ""), "phone": phone(k) in (t or "") and k % 2 == 0, "attested": phone(k) in (t or "") and k % 2 == 1, "name": says(f"{f} {n}") or says(f"{f[0]} {n}")}
            if any(s.values()):
                s |= {"org": i["organization"].lower() in org, "location": i["location"].lower() in loc, "common": s["name"]}
                exact, cor = s["email"] or s["phone"], s["org"] + s["location"]
                raw = (90 if exact else 60 if s["attested"] else 30) + 5 * s["org"] + 3 * s["location"] - 10 * s["common"]
                raw = min(raw, 50) if s["name"] and not exact else raw
                label = "CONFIRMED" if exact or (s["name"] and cor >= 2) else "POTENTIAL"
                want[k, d] = (",".join(x for x in ("email", "phone", "attested", "name", "org", "location", "common") if s[x]), min(raw, 98) / 100, label)
    got = catalog.queries()["correlate_identities"](spark, str(tmp_path)).collect()
    assert {(r["identity_id"], r["doc_id"]): (r["signals"], round(r["confidence"], 6), r["match_label"]) for r in got if r["doc_id"]} == want
    assert {r["identity_id"] for r in got if r["doc_id"] is None} == set(who) - {k for k, _ in want}
    assert len(got) == len(want) + len(set(who) - {k for k, _ in want})
    assert {d for _, d in want} == {1, 2, 3, 4, 5, 6} and len({v for v in want.values()}) >= 6
    assert len({r["severity"] for r in got}) > 2 and len({r["actions"] for r in got}) > 2


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_redaction_leaves_no_address(spark):
    df = catalog.queries()["redact_documents"](spark, DATA)
    from veilscan.functions.detect import emails

    from pyspark.sql import functions as F

    left = df.select(F.explode(emails(F.col("redacted"))).alias("s")).filter("s.raw not like '%*%'")
    assert left.count() == 0


def test_search_answers(spark):
    answer = {"searches": [{"person_id": "p", "query": "q", "results": [{"title": "T", "url": "http://a/x.pdf?1", "position": 9}, {"url": ""}, {"url": "http://b", "snippet": "s"}]}]}
    got = records.search_rows(spark.createDataFrame([(json.dumps(answer),), (None,), ("bad",)], "json string")).collect()
    assert [(r["title"], r["position"], r["snippet"], r["content_type"]) for r in got] == [("T", 9, "", "pdf"), ("http://b", 3, "s", "html")]


def test_recorded_search_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"searches": [{"query": "q", "results": [{"url": "u"}, {"title": "t", "url": "v", "position": 7}]}]}))
    spark.dataSource.register(records.RecordedSearch)
    got = spark.read.format("recorded_search").load(str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(None, "q", "t", "v", "", 7), (None, "q", "u", "u", "", 1)]


def test_breach_answers(spark):
    names = spark.createDataFrame([("a", json.dumps({"breaches": [["X", " ", "Y"], ["Z"]]})), ("b", json.dumps({"Error": "Not found"})), ("c", json.dumps({"breaches": [[f"N{i}" for i in range(40)]]}))], "email string, json string")
    got = {r["email"]: (r["names"], r["total"]) for r in records.breach_names(names).collect()}
    assert got["a"] == (["X", "Y", "Z"], 3) and got["b"] == ([], 0) and (len(got["c"][0]), got["c"][1]) == (25, 40)
    metrics = spark.createDataFrame([("a", json.dumps({"BreachMetrics": {"get_details": [{"breach": "x", "xposed_data": ["Passwords"]}, {"name": "Y", "xposed_data": ["Email addresses"]}], "passwords_strength": {"PlainText": 1}}}))], "email string, json string")
    found = {r["name"]: r["credential"] for r in records.breach_rows(records.breach_names(names.filter("email = 'a'")), records.breach_details(metrics)).collect()}
    assert found == {"X": True, "Y": False, "Z": True}


def test_catalogs(spark, tmp_path):
    brokers = [{"name": "A", "domain": "a.com", "category": "c", "optOutUrl": "u", "instructions": "i", "domains": ["b.com"]}, {"name": "B", "domain": "d.com", "category": "c", "optOutUrl": "v", "instructions": "i"}]
    (tmp_path / "l.json").write_text(json.dumps(brokers))
    (tmp_path / "o.json").write_text(json.dumps({"brokers": brokers}))
    for f in ("l.json", "o.json"):
        assert [(r["name"], r["domains"]) for r in records.catalog(spark, str(tmp_path / f)).orderBy("name").collect()] == [("A", ["b.com"]), ("B", [])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "web", "u"), (1, "breach", "v")], "scan_id int, source string, url string")
    records.append(df, str(tmp_path / "rows"))
    records.append(df, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).filter("source = 'web'").count() == 2
    records.publish(df, str(tmp_path / "state"), 3)
    assert spark.read.parquet(str(tmp_path / "state")).select("version").distinct().first()[0] == 3
    assert [r["ok"] for r in records.integrity({"a": (df, 2), "b": (df, 3)}).orderBy("input").collect()] == [True, False]


def test_catalog_positions_follow_files(spark, tmp_path):
    for k, names_ in enumerate((["A", "B"], ["C"], ["D", "E"])):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"name": n, "domain": f"{n.lower()}.com", "optOutUrl": "u", "instructions": f"ask {n}"} for n in names_]))
    got = records.catalog(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["name"], r["position"], r["instructions"]) for r in got] == [(n, i, f"ask {n}") for i, n in enumerate("ABCDE")]


def test_report_is_written_where_its_rows_are(spark, tmp_path):
    rows = spark.createDataFrame([("a", "CONFIRMED"), ("b", "NO_MATCH")], "person_id string, classification string")
    people = evaluate.by_person(rows)
    wrong = spark.range(1000).selectExpr("concat('e', id) as entry_id", "'CONFIRMED' as expected", "'NO_MATCH' as actual").repartition(5)
    records.report(evaluate.decoys(rows), people, wrong, str(tmp_path / "r"))
    made = {kind: [json.loads(line) for f in (tmp_path / "r" / f"kind={kind}").glob("part-*") for line in f.read_text().splitlines()] for kind in ("summary", "person", "mismatch")}
    assert made["summary"][0]["verdict"] == "FAIL" and len(made["person"]) == 3
    assert len(made["mismatch"]) == 1000 and {"entry_id": "e7", "expected": "CONFIRMED", "actual": "NO_MATCH"} in made["mismatch"]
    assert len(list((tmp_path / "r" / "kind=mismatch").glob("part-*"))) == 5


def test_explanations_come_from_a_provider_or_the_template(spark):
    from veilscan.operators import candidates, monitor

    rows = spark.createDataFrame([(1, "HIGH", "CREDENTIAL_EXPOSURE", 0.9, ["CREDENTIAL_STUFFING"], ["ENABLE_MFA"], [("a.in", "document")]), (2, None, None, None, None, None, [])], "id long, severity string, exposure_type string, confidence double, threats array<string>, actions array<string>, evidence array<struct<domain:string,tier:string>>")
    safe = monitor.redacted_finding(rows)
    first, second = safe.orderBy("id").collect()
    assert (first["tier"], first["domains"], first["actions"]) == ("document", ["a.in"], ["ENABLE_MFA"])
    assert tuple(second)[1:] == ("LOW", "UNKNOWN", 0.0, 0.0, "snippet", ["unknown"], [], [])
    plain = {r["id"]: r for r in candidates.explained_by(safe).collect()}
    assert plain[1]["summary"].startswith("HIGH credential exposure at a.in") and plain[2]["provider"] == "template"
    seen = candidates.explained_by(safe, lambda findings: [f"{f['risk']} at {f['domains'][0]}" if f["threats"] else None for f in findings])
    got = {r["id"]: (r["summary"], r["provider"]) for r in seen.collect()}
    assert got == {1: ("HIGH at a.in", "model"), 2: (plain[2]["summary"], "template")}
    assert candidates.explained_by(safe.limit(0), lambda findings: []).count() == 0


def test_recognizer_rows_that_pass(spark):
    from veilscan.operators import entities

    docs = spark.createDataFrame([(1, "Ann  Lee of Pune"), (2, None)], "doc_id long, text string")
    rows = [(1, "Person", "Ann Lee", 0.9, 0, 8), (1, "person", "Ann Lee", 0.39, 0, 8), (1, "city", "Pune", 0.9, 12, 16), (1, "person", "Bob", 0.9, 0, 3), (1, "person", "e", 0.9, 15, 99), (1, "person", "x", float("nan"), 0, 1), (2, "person", "x", 0.9, 0, 1)]
    got = entities.reported(spark.createDataFrame(rows, "doc_id long, label string, text string, score double, start int, end int"), docs, ["person"])
    assert [(r["label"], r["start"], r["end"]) for r in got.collect()] == [("Person", 0, 8)]


def test_extraction_without_a_recognizer_is_partial(spark):
    from pyspark.sql import functions as F
    from veilscan.functions import detect
    from veilscan.operators import entities

    docs = spark.createDataFrame([(1, "a@b.in here"), (2, " "), (3, None), (4, "x" * 20001)], "doc_id long, text string")
    found = docs.select("doc_id", F.explode(detect.emails(F.col("text"))).alias("s")).select("doc_id", "s.*")
    got = {r["doc_id"]: (r["skipped"], r["truncated"], r["partial"], [e["provenance"] for e in r["entities"]]) for r in entities.extracted(docs, found).collect()}
    assert got == {1: (False, False, True, [["regex"]]), 2: (True, False, False, []), 3: (True, False, False, []), 4: (False, True, True, [])}


def e164(raw):
    digits, plus = re.sub(r"\D", "", raw), raw.lstrip().startswith("+")
    for code in sorted(NUMBER_PLANS, key=len, reverse=True):
        rest = re.sub("^0", "", digits[len(code) :])
        if plus and digits.startswith(code) and re.fullmatch(NUMBER_PLANS[code], rest):
            return f"+{code}{rest}"
    national = re.sub("^0", "", digits)
    if not plus and re.fullmatch(NUMBER_PLANS["91"], national):
        return "+91" + national
    if not plus and digits.startswith("91") and re.fullmatch(NUMBER_PLANS["91"], digits[2:]):
        return "+91" + digits[2:]
    return None


def numbers_in(text):
    """(start, end) of numbers: spans, or else their longest runs of tokens, as a loop over both."""
    out = []
    for m in re.finditer(detect.PHONE, text):
        if e164(m.group()):
            out.append(m.span())
            continue
        tokens = [t.span() for t in re.finditer(r"\S+", m.group())][:12]
        kept = []
        for n in range(len(tokens), 0, -1):
            for k in range(len(tokens) - n + 1):
                a, b = tokens[k][0], tokens[k + n - 1][1]
                if e164(m.group()[a:b]) and not any(max(a, c) < min(b, d) for c, d in kept):
                    kept.append((a, b))
        out += [(m.start() + a, m.start() + b) for a, b in kept]
    return out


def addresses_in(text):
    """(start, end) of addresses: runs of their characters around an @, whose labels are looked at one by one."""
    out = []
    for at in (m.start() for m in re.finditer("@", text)):
        local = re.search(r"[A-Za-z0-9._%+-]*$", text[:at]).group()
        domain = re.match(r"[A-Za-z0-9._%+-]*", text[at + 1 :]).group()
        labels = domain.split(".")
        fine = all(x and re.fullmatch("[A-Za-z0-9-]+", x) and x[0] != "-" and x[-1] != "-" for x in labels)
        if all(local.split(".")) and len(local) <= 64 and len(labels) > 1 and fine and labels[-1].isalpha() and len(labels[-1]) > 1 and len(local + domain) < 254:
            out.append((at - len(local), at + 1 + len(domain)))
    return out


def checks(digits):
    """The checksum as its definition has it: symmetries of a pentagon, as permutations of its corners."""
    turn = lambda k: tuple((i + k) % 5 for i in range(5))
    flip = lambda k: tuple((k - i) % 5 for i in range(5))
    group = [turn(k) for k in range(5)] + [flip(k) for k in range(5)]
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    c = group[0]
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        for _ in range(i % 8):
            x = step[x]
        c = tuple(c[k] for k in group[x])
    return c == group[0]


def spans_in(text):
    """(type, start, end, confidence) of all detectors, the surest first, then the longest, without overlaps."""
    found = [("EMAIL", a, b, 0.95) for a, b in addresses_in(text)]
    found += [("PHONE", a, b, 0.80 if re.fullmatch(r"91\d{10}", text[a:b].strip()) else 0.95) for a, b in numbers_in(text)]
    for m in re.finditer(r"(?<!\d)[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?!\d)", text):
        digits = re.sub(r"\D", "", m.group())
        if len(set(digits)) > 1:
            found.append(("AADHAAR", *m.span(), 0.98 if checks(digits) else 0.40))
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z]{5}\d{4}[A-Za-z](?![A-Za-z0-9])", text):
        found.append(("PAN", *m.span(), 0.95 if m.group()[3].upper() in "PCHFATBLJG" else 0.60))
    kept = []
    for s in sorted(found, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        if not any(max(s[1], k[1]) < min(s[2], k[2]) for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


PIECES = ["+91 98765 43210", "098765-43210", "919876543210", "+1 (415) 555-2671", "+44 7911 123456", "+49 151 23456789", "+33 6 12 34 56 78", "+34 612345678", "12345", "9876543210", "8765432109", "1234 5678 9012 3456", "10.0.0.1", "2345 6789 0124", "2345-6789-0123", "999999999999", "abcpe1234f", "ABCZE1234F", "xABCPE1234F", "a.b@mail.example.com", "u@x", "m@n-.in", "é@a.co", "q@r.in.", "two@at@b.org", "word"]


def texts_of_pieces(spark, tmp_path, n=200):
    rng = random.Random(17)
    texts = [(i, "s", "en", rng.choice([" ", ", ", " and ", "; ", "😀"]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 6)))) for i in range(n)] + [(n, "s", "en", ""), (n + 1, "s", "en", None)]
    spark.createDataFrame(texts, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [(i, x or "") for i, _, _, x in texts]


def test_numbers_of_all_plans_are_those_of_a_plain_loop(spark, tmp_path):
    texts = texts_of_pieces(spark, tmp_path)
    got = catalog.queries()["pii_phones_all"](spark, str(tmp_path)).collect()
    want = sorted((i, x[a:b], a, e164(x[a:b])) for i, x in texts for a, b in numbers_in(x))
    assert sorted((r["doc_id"], r["raw"], r["start"], r["e164"]) for r in got) == want
    assert len({w[3][:3] for w in want}) >= 6


def test_all_detectors_and_redaction_are_those_of_a_plain_loop(spark, tmp_path):
    texts = texts_of_pieces(spark, tmp_path)
    got = catalog.queries()["detect_all_resolved"](spark, str(tmp_path)).collect()
    want = sorted((i, t, x[a:b], a, b, c) for i, x in texts for t, a, b, c in spans_in(x))
    assert sorted((r["doc_id"], r["type"], r["raw"], r["start"], r["end"], r["confidence"]) for r in got) == want
    assert {w[1] for w in want} == {"EMAIL", "PHONE", "AADHAAR", "PAN"} and {w[5] for w in want} == {0.4, 0.6, 0.8, 0.95, 0.98}
    redacted = {r["doc_id"]: (r["n"], r["redacted"]) for r in catalog.queries()["redact_documents"](spark, str(tmp_path)).collect()}
    masks = {(r["kind"], r["raw"]): r["m"] for r in spark.createDataFrame({(w[1], w[2]) for w in want}, "kind string, raw string").withColumn("m", normalize.mask(F.col("kind"), F.col("raw"))).collect()}
    for i, x in texts[:-1]:
        out, at = "", 0
        for t, a, b, _ in spans_in(x):
            out, at = out + x[at:a] + masks[t, x[a:b]], b
        assert redacted[i] == (len(spans_in(x)), out + x[at:])


def test_golden_rules(spark):
    person = [("p", "Rahul Kumar", "r@x.in", "+91 98765 43210", "rk", "Org", "Pune, India", "Pune", "MH")]
    entries = [
        ("email", "p", None, "R@X.in ", None, None, None, None, None, None, "CONFIRMED"),
        ("phone", "p", None, None, "+919876543210", None, None, None, None, None, "CONFIRMED"),
        ("user", "p", None, None, None, "R K", None, None, None, None, "CONFIRMED"),
        ("composite", "p", "rahul kumar", None, None, None, "org", None, "PUNE", None, "POTENTIAL"),
        ("one", "p", "Rahul Kumar", None, None, None, "Org", None, None, None, "NO_MATCH"),
        ("name", "p", "Rahul Kumar", None, None, None, None, None, None, None, "NO_MATCH"),
        ("other", "p", "Rohit Kumar", None, None, None, "Org", "Pune, India", "Pune", None, "NO_MATCH"),
    ]
    fields = "name string, email string, phone string, username string, organization string, location string, city string, state string"
    e = spark.createDataFrame([x[:-1] for x in entries], f"entry_id string, person_id string, {fields}")
    got = evaluate.classified(e, spark.createDataFrame(person, f"person_id string, {fields}"))
    assert {r["entry_id"]: r["classification"] for r in got.collect()} == {x[0]: x[-1] for x in entries}
    total = evaluate.by_person(got).filter("person_id is null").first()
    assert (total["confirmed"], total["potential"], total["no_match"]) == (3, 1, 3)
    assert evaluate.decoys(got.filter("classification = 'NO_MATCH'")).first()["verdict"] == "PASS"


ODD = [
    "a@b.com c@d.com, e@f.org\ng@h.net;i@j.net k@l.de",
    "a@b.com a@b.com a@b.com a@b.com",
    "+1 (234) 567-8901 +1 (345) 678-9012 +1 (456) 789-0123",
    "+1 (234) 567-8901\n+1 (234) 567-8901\n+1 (234) 567-8901, +1 (234) 567-8901\n",
    "+1 (234) 567-8901-2, ++1 (234) 567-8901 3 4 5, +1 (234) 678-9012 3 4 5",
    "+1 (234) 567-89012, 1+1 (234) 567-8901, +1 (134) 567-8901, +1 (034) 567-8901, +1 (234) 067-8901",
    "x+1 (234) 567-8901x\U0001f600+1 (345) 678-9012\U0001f600 +1 345 678 9012 +1-345-678-9013 +13456789014 +1\t(345) 678-9015",
    "",
    None,
]


@pytest.mark.parametrize("name", ["ner_contained_discard", "ner_chunk_dedupe", "pii_phones_e164", "match_phone"])
def test_neighbours_in_a_text_are_those_of_the_sql(spark, tmp_path, name):
    texts = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(catalog.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.values.tolist())) == sorted(want) and want
