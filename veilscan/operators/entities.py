"""Entities of documents: fusion of detected spans with a recognizer's, and correlation with monitored identities."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, rules
from ..functions.detect import e164
from ..functions.normalize import digits, email
from ..functions.text import MOST, iou
from ..sources.dims import NER_TYPES
from ..sources.scratch import written
from .contain import containing, gazetted  # noqa: F401  (queries take gazetted from here)
from .spans import chosen, overlapping

#: Least score of a recognized span; overlap from which two spans of a label are one.
LEAST_SCORE, SAME = 0.40, 0.5


def recognized(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, label, text, score, start, end, n_chars) that a recognizer may report, with their type."""
    kind = F.create_map(*[F.lit(x) for kv in NER_TYPES.items() for x in kv])
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_chars")) & ~F.isnan("score") & F.col("score").between(LEAST_SCORE, 1.0)
    return rows.withColumn("type", F.try_element_at(kind, F.lower("label"))).filter(ok & F.col("type").isNotNull())


def reported(rows: DataFrame, docs: DataFrame, labels: list[str], threshold: float = LEAST_SCORE) -> DataFrame:
    """Of a recognizer's rows those that a service passes on: a label that was asked for, a score of at least the threshold,
    valid offsets, and text that is the document's at these offsets up to white space."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    r = rows.filter(F.lower("label").isin(*[x.lower() for x in labels]) & ~F.isnan("score") & (F.col("score") >= threshold) & (F.col("score") <= 1.0) & (F.col("start") >= 0) & (F.col("start") < F.col("end")))
    own = r.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id").filter(F.col("end") <= F.length("__text"))
    return own.filter(plain(F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start"))) == plain(F.col("text"))).drop("__text")


def deduplicated(rows: DataFrame) -> DataFrame:
    """Of spans of one document and label that are the same or half the same, the best scored, found greedily."""
    near = lambda l, r: iou(F.col(f"{l}start"), F.col(f"{l}end"), F.col(f"{r}start"), F.col(f"{r}end")) >= SAME  # noqa: E731, E741
    ranked = rows.select("doc_id", "label", "text", "score", "start", "end", (-F.col("score")).alias("loss"))
    return chosen(ranked, ["doc_id", "label"], ["loss"], near).select("doc_id", "label", "text", "score", "start", "end")


def recognize(docs: DataFrame, predict, labels: list[str], threshold: float = LEAST_SCORE) -> DataFrame:
    """A pluggable recognizer over (doc_id, start, text) chunks: ``predict(text, labels, threshold)`` gives dicts of label, text, score, start, end; offsets become the document's."""

    def run(batches):
        for b in batches:
            rows = [(d, e["label"], e["text"], float(e["score"]), int(s + e["start"]), int(s + e["end"])) for d, s, t in zip(b["doc_id"], b["start"], b["text"]) for e in predict(t, labels, threshold)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "text", "score", "start", "end"])

    return docs.select("doc_id", "start", "text").mapInPandas(run, "doc_id long, label string, text string, score double, start int, end int")


def fuse(found: DataFrame, ner: DataFrame) -> DataFrame:
    """Structured spans with the score of the best recognized span of their type that overlaps; recognized spans that are neither taken up nor inside a structured span of another type follow.

    Overlaps are found once, by position inside a document. Empty spans overlap nothing and lie in nothing."""
    made_by = F.col("provenance") if "provenance" in found.columns else F.array(F.lit("regex"))
    f = found.select("doc_id", "type", "raw", "normalized", "confidence", made_by.alias("provenance"), "start", "end")
    n = ner.select("doc_id", F.col("type").alias("n_type"), F.col("text").alias("n_raw"), "score", F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    pairs = overlapping(f.select("doc_id", "type", "start", "end"), n.select("doc_id", F.col("n_type").alias("type"), "score", F.col("n_start").alias("start"), F.col("n_end").alias("end")), ["doc_id"])
    pairs = written(pairs.withColumn("same", F.col("l_type") == F.col("r_type")))
    named = lambda p, *cs: [F.col(f"{p}_{c}").alias(c) for c in cs]
    best = pairs.filter("same").groupBy("doc_id", *named("l", "type", "start", "end")).agg(F.max("r_score").alias("ner_score"))
    taken = F.col("ner_score").isNotNull()
    made_by = F.when(taken, F.array_union("provenance", F.array(F.lit("ner")))).otherwise(F.col("provenance")).alias("provenance")
    structured = f.join(best, ["doc_id", "type", "start", "end"], "left").select("doc_id", "type", "raw", "normalized", "start", "end", F.when(taken, "fused").otherwise("regex").alias("detector"), F.col("confidence").cast("double").alias("confidence"), "ner_score", made_by)
    inside = (F.col("l_start") <= F.col("r_start")) & (F.col("r_end") <= F.col("l_end"))
    gone = pairs.filter(F.col("same") | inside).select("doc_id", *[F.col(f"r_{c}").alias(f"n_{c}") for c in ("type", "start", "end")]).distinct()
    rest = n.join(gone, ["doc_id", "n_type", "n_start", "n_end"], "left_anti").dropDuplicates(["doc_id", "n_type", "n_raw", "n_start", "n_end"])
    rest = rest.select("doc_id", F.col("n_type").alias("type"), F.col("n_raw").alias("raw"), F.trim("n_raw").alias("normalized"), F.col("n_start").alias("start"), F.col("n_end").alias("end"), F.lit("ner").alias("detector"), F.col("score").alias("confidence"), F.col("score").alias("ner_score"), F.array(F.lit("ner")).alias("provenance"))
    return structured.unionByName(rest)


def extracted(docs: DataFrame, found: DataFrame, ner: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """One row for each (doc_id, text) document: its fused entities and how complete they are.

    ``skipped``: the text is null or blank, so nothing was looked for. ``truncated``: it is longer than a recognizer reads.
    ``partial``: there was no recognizer (``ner`` is None), it failed for this document (``status``: doc_id, failed,
    covered), its windows left a tail, or the text was truncated; structured entities are there all the same."""
    if ner is None:
        ner = found.select("doc_id", "type", F.lit("").alias("text"), F.lit(0.0).alias("score"), "start", "end").limit(0)
        missing = F.lit(True)
    else:
        missing = F.lit(False)
    entity = F.struct("start", "end", "type", "raw", "normalized", "detector", "confidence", "ner_score", "provenance")
    e = fuse(found, ner).groupBy("doc_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    d = docs.select("doc_id", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("skipped"), (F.coalesce(F.length("text"), F.lit(0)) > MOST).alias("truncated"))
    if status is not None:
        d = d.join(status.groupBy("doc_id").agg(F.bool_or(F.coalesce("failed", F.lit(False)) | ~F.coalesce("covered", F.lit(True))).alias("short")), "doc_id", "left")
    else:
        d = d.withColumn("short", F.lit(False))
    incomplete = ~F.col("skipped") & (missing | F.coalesce("short", F.lit(False)) | F.col("truncated"))
    d = d.join(e, "doc_id", "left")
    none = F.from_json(F.lit("[]"), e.schema["entities"].dataType)
    return d.select("doc_id", "skipped", "truncated", incomplete.alias("partial"), F.when(F.col("skipped") | F.col("entities").isNull(), none).otherwise(F.col("entities")).alias("entities"))


def signals(identities: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each (identity, document) that any key or name links, with its signals.

    Addresses, numbers and user names of all kinds are tagged keys of one join; names are matched by their rarest tokens.
    Entities and identities are computed once. Organization and location only
    corroborate pairs that exist already; empty values match nothing."""
    pair = ["identity_id", "doc_id"]
    # both are read several times: entities may come from a pass over all texts
    e = written(entities.select("doc_id", "type", "normalized").distinct())
    identities = written(identities)
    # both sides in international form where a numbering plan has them, so a local number meets its own
    number = lambda c: digits(F.coalesce(e164(c), c))
    key = lambda kind, k, signal: F.when(F.coalesce(k, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), k.alias("k"), signal.alias("signal")))
    phone = F.when(F.col("is_phone_verified"), "phone").otherwise("attested")
    own = F.array(key("e", email(F.col("email")), F.lit("email")), key("p", number(F.col("phone")), phone), key("u", email(F.col("username")), F.lit("username")))
    own = identities.select("identity_id", F.explode(F.array_compact(own)).alias("key")).select("identity_id", "key.*")
    asked = {r["kind"] for r in own.select("kind").distinct().collect()}  # at most three: what no identity has isn't looked for
    value, none = email(F.col("normalized")), F.lit(None).cast("string")
    keys = {"e": F.when(F.col("type") == "EMAIL", key("e", value, none)), "p": F.when(F.col("type") == "PHONE", key("p", number(F.col("normalized")), none)), "u": key("u", value, none)}
    # repeated keys of a document fall together with its pairs
    said = e.select("doc_id", F.explode(F.array_compact(F.array(*[keys[k] for k in sorted(asked or keys)]))).alias("key")).select("doc_id", "key.kind", "key.k")
    by_key = own.join(said, ["kind", "k"]).select(*pair, "signal")
    people = e.filter("type = 'PERSON'").select("normalized").distinct()
    named = names.matches(identities, people, "identity_id", "name", "normalized", "normalized")
    by_name = named.join(e.filter("type = 'PERSON'"), named.right_id == e.normalized).select(F.col("left_id").alias("identity_id"), "doc_id", F.lit("name").alias("signal"))
    linked = by_key.unionByName(by_name)
    base = written(linked.groupBy(*pair).agg(*[F.bool_or(F.col("signal") == s).alias(s) for s in ("email", "phone", "attested", "username", "name")]))
    types = e.groupBy("doc_id").agg(F.array_sort(F.collect_set("type")).alias("pii_types"))
    # what an identity has lies in what a document says, or the other way round: distinct values meet by anchors
    said = e.filter("type in ('ORGANIZATION', 'LOCATION', 'ADDRESS')").select("doc_id", F.when(F.col("type") == "ORGANIZATION", "org").otherwise("location").alias("kind"), F.lower(F.trim("normalized")).alias("said"))
    own = identities.select("identity_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.trim(c)).alias("own")) for k, c in (("org", "organization"), ("location", "location"))])).alias("x")).select("identity_id", "x.*").filter("own <> ''")
    alike = containing(own, said, "own", "said").unionByName(containing(said, own, "said", "own")).distinct()
    near = base.select(*pair).join(own, "identity_id").join(alike, "own").join(said, ["doc_id", "kind", "said"])
    near = near.groupBy(*pair).agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("org", "location")])
    common = identities.select("identity_id", names.is_common(names.tokens(F.col("name"))).alias("common"))
    out = base.join(near, pair, "left").join(types, "doc_id").join(common, "identity_id")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select(*pair, "email", "phone", "attested", "username", "name", flag("org"), flag("location"), (flag("common") & F.col("name")).alias("common"), "pii_types")


def outcomes(matched: DataFrame, sources: Column | None = None, breach: Column | None = None, kind: Column | None = None) -> DataFrame:
    """Signals with confidence, label, type, threats, severity, rank and actions."""
    n = F.lit(1) if sources is None else sources
    dumped = F.lit(False) if breach is None else breach
    m = matched.withColumn("c", rules.identity_confidence(*[F.col(c) for c in ("email", "phone", "username", "attested", "name", "org", "location")], n, F.col("common")))
    m = m.withColumn("exposure_type", rules.exposure_type(F.col("pii_types")) if kind is None else kind)
    m = m.withColumn("threats", rules.threats(F.col("exposure_type"), F.col("pii_types"), F.col("c.match_label"), dumped, n))
    m = m.withColumn("s", rules.severity(F.col("exposure_type"), F.col("pii_types"), F.col("c.match_label"), dumped, F.col("c.confidence")))
    m = m.withColumn("actions", rules.actions(F.col("exposure_type"), F.col("pii_types"), F.col("c.match_label"), F.col("threats"), F.lit(None).cast("string")))
    return m.select("identity_id", "doc_id", "exposure_type", "pii_types", "c.confidence", "c.match_label", "s.severity", "s.rank", "threats", "actions")


def independent_sources(entities: DataFrame, by: str = "source") -> DataFrame:
    """Distinct sources of each normalized value."""
    return entities.groupBy("type", "normalized").agg(F.count_distinct(by).alias("sources"))
