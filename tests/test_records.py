"""Recorded answers in every shape: spellings, wrong kinds, unknown fields, damaged text."""

import json

from pyspark.sql import functions as F

from veilscan.functions import variants as V
from veilscan.sources import records


def answers(spark, *values):
    return spark.createDataFrame([(f"e{i}", v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "email string, json string")


def test_fields_by_kind_and_spelling(spark):
    rows = answers(spark, {"Name": "x", "TITLE": "t", "n": 5, "xs": ["a", 1, " ", None, "b"]}, {"name": 7, "title": "  ", "n": "5", "xs": "a"}, {"name": None, "TITLE": "u"}, "bad", None, [1], "3", '{"a":1,"a":2}', {"name": "y" * 3_000_000})
    v = V.fields(V.parsed(F.col("json")))
    got = rows.select(V.text(v, "name", "title").alias("t"), V.any_text(v, "title").alias("any"), V.number(v, "n").alias("n"), V.texts(v, "xs").alias("xs"), F.size(V.items(v, "xs")).alias("size"), V.rest(v, "name", "title").alias("rest")).collect()
    assert [(r["t"], r["any"], r["n"], r["xs"], r["size"]) for r in got[:4]] == [("x", "t", 5.0, ["a", "b"], 5), (None, "  ", None, None, None), ("u", "u", None, None, None), (None,) * 5]
    assert json.loads(got[0]["rest"]) == {"n": 5, "xs": ["a", 1, " ", None, "b"]} and got[2]["rest"] is None
    assert all(tuple(r) == (None,) * 6 for r in got[3:8])
    assert len(got[8]["t"]) == 3_000_000


def test_first_named_spelling_counts(spark):
    rows = answers(spark, {"title": "c", "breach": "b", "name": "a"}, {"title": "c", "breach": "b", "name": " "}, {"title": "c", "breach": {"x": 1}})
    assert [r[0] for r in rows.select(V.text(V.fields(V.parsed(F.col("json"))), *records.BREACH_NAME)).collect()] == ["a", "b", "c"]


def test_breach_answers_of_every_shape(spark):
    names = answers(spark, {"breaches": ["A", ["B", 3, ""], [["deep"]]]}, {"Breaches": [["A"]], "Error": ""}, {"breaches": [["A"]], "Error": "Not found"}, {"breaches": "A"}, {"breaches": []}, None, "no json")
    got = {r["email"]: r["names"] for r in records.breach_names(names).collect()}
    assert got == {"e0": ["A", "B"], "e1": ["A"], "e2": [], "e3": [], "e4": [], "e5": [], "e6": []}
    details = [{"title": "a", "date": "2020", "dataClasses": ["Passwords"]}, {"name": "B", "xposed_data": [], "data_classes": ["Emails"], "logo": {"w": 1}}, {"breach": "A", "xposed_data": ["Emails"]}, {"xposed_data": ["nameless"]}]
    metrics = answers(spark, {"breach_metrics": {"get_details": details, "risk": [{"risk_label": "Low"}, {"risk_label": "High"}], "passwords_strength": {"PlainText": 1}}}, {"BreachMetrics": {"passwords_strength": {"EasyToCrack": 2}}}, {"BreachMetrics": None})
    out = {(r["email"], r["name"]): r for r in records.breach_rows(records.breach_names(names), records.breach_details(metrics)).collect()}
    assert set(out) == {("e0", "A"), ("e0", "B"), ("e1", "A")}  # a repeated detail makes no second row
    a, b, c = out["e0", "A"], out["e0", "B"], out["e1", "A"]
    assert (a["date"], a["credential"], a["snippet"]) == (None, False, 'Email address appears in the "A" breach record. Exposed data: Emails.')
    assert (b["credential"], json.loads(b["other"]), b["risk_label"]) == (False, {"logo": {"w": 1}}, "Low")
    assert (c["credential"], c["risk_label"], c["other"], c["title"]) == (True, None, None, "Breach record: A")


def test_live_and_recorded_searches(spark):
    live = {"organic": [{"title": "", "link": "http://a", "date": "d"}, {"link": ""}, {"title": "no link"}, {"link": "http://b/x.PDF#p", "position": 9}]}
    got = records.search_rows(answers(spark, live, {"searches": []}, {"searches": [{"query": "q"}]}, "[]", None, "bad")).collect()
    assert [(r["title"], r["url"], r["position"], r["content_type"], r["other"]) for r in got] == [("", "http://a", 1, "html", '{"date":"d"}'), ("http://b/x.PDF#p", "http://b/x.PDF#p", 9, "pdf", None)]


def test_corpus_folder(spark, tmp_path):
    for name, entry in (("a", {"id": "1", "Name": "x", "n": 1}), ("b", {"name": ["no text"]}), ("c", {"full_name": "z"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(entry, indent=1))
    got = records.corpus(spark, str(tmp_path), {"id": ("id",), "name": ("name", "full_name")}).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("1", "x", '{"n":1}', "a.json"), (None, None, None, "b.json"), (None, "z", None, "c.json")]


def test_expected_totals_of_both_versions(spark):
    two = {"target_profiles": [], "expected_results": {"p1": {"confirmed": 3, "potential": 2, "no_match": 1}, "p2": {"confirmed": 4, "potential": 0, "no_match": 0}}}
    one = {"target_profile": {}, "expected_confirmed": {"email": ["a", "b"], "phone": [], "username": ["c"]}, "expected_potential": [{}, {}]}
    got = {(r["version"], r["label"]): r["n"] for r in records.expected_totals(answers(spark, two, one, None, "bad", {})).collect()}
    assert got == {(2, "confirmed"): 7, (2, "potential"): 2, (2, "no_match"): 1, (1, "confirmed_email"): 2, (1, "confirmed_phone"): 0, (1, "confirmed_username"): 1, (1, "potential"): 2}
    assert records.expected_totals(answers(spark, None)).count() == 0
