"""License scan: ordered signature rules over the words of a text, in DataFrame functions alone.

A text becomes its words, in lower case and with one space between. A rule is a pattern over these words with a label, a
priority and a keyword (``license_rules``). Plain substring tests choose what a text is matched against: first a few
parts of words, of which most texts hold none, then keywords. A detection is a run of words; one that lies inside another
of at least its priority is suppressed. The base phrases are always reported.

Patterns run once over a text, and places and suppression are running sums and maxima, so the work is in proportion to
the text and its detections.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import blocks, let, matches
from .common import LOWER, UPPER, table
from .license_rules import STEMS, rules

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
FOUND = "array<struct<first:int,stop:int,priority:int,label:string,level:int>>"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _detections(norm: Column, rule: Column) -> Column:
    """Runs of words (first, past the last) where a rule's pattern stands; ends and priorities are negative, for sorting."""
    runs = matches(norm, rule["pattern"], _spaces)  # spaces before a match: it starts at word spaces - 1
    return F.transform(runs, lambda r: F.struct((r["start"] - 1).alias("first"), (-r["end"]).alias("stop"), (-rule["priority"]).alias("priority"), rule["label"].alias("label"), rule["level"].alias("level")))


def _kept(found: Column, levels: int) -> Column:
    """Detections in order of first word, longest first, without those inside an earlier one of at least their priority.

    A state holds, for each level of priority, the furthest end so far of detections of that level or more."""
    zero = F.array_repeat(F.lit(-1), levels)
    raised = lambda state, d: F.transform(state, lambda x, i: F.when(i <= d["level"], F.greatest(x, -d["stop"])).otherwise(x))

    def flags(piece: Column, state: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast("array<boolean>").alias("out"))
        step = lambda acc, d: F.struct(raised(acc["state"], d).alias("state"), F.concat(acc["out"], F.array(F.get(acc["state"], d["level"]) >= -d["stop"])).alias("out"))
        return F.aggregate(piece, begin, step)["out"]

    def judged(pieces: Column) -> Column:
        begin = F.struct(zero.alias("state"), F.array().cast("array<array<int>>").alias("out"))
        over = lambda acc, piece: F.struct(F.aggregate(piece, acc["state"], raised).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))
        return F.flatten(F.zip_with(pieces, F.aggregate(pieces, begin, over)["out"], flags))

    def chosen(xs: Column) -> Column:
        return let(let(blocks(xs), judged), lambda inside: F.filter(xs, lambda x, i: ~F.get(inside, i)))

    return F.when(F.size(found) > 0, let(F.array_sort(found), chosen)).otherwise(F.array().cast(FOUND))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: n_words, n_base, first_word, last_word, base_labels, labels, score and the detections.

    A null or empty text has no word and no label: empty strings, null places, score 0. A very long text is scanned whole.
    Of detections of one run and priority (ties) the first label in order is kept. Repeated rows each get their answer;
    other columns are not read, whatever their names; an empty table gives no rows. The score is the best priority among
    kept detections over 100, and at least 0.5 where a base phrase stands."""
    table_ = rules()
    keywords = sorted({k for _, k, _, _ in table_})
    levels = sorted({n for *_, n in table_})
    gap = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
    # one pass for letters and gaps (NUL can't be a replacement), one for runs of gaps
    spaced = F.translate(F.coalesce(docs[text], F.lit("")), UPPER + gap, LOWER + " " * len(gap))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, " {2,}", " ")), F.lit(" "))
    d = docs.select(docs[doc_id].alias("doc_id"), norm.alias("norm"))
    d = d.withColumn("n_words", F.when(F.col("norm") == "  ", F.lit(0)).otherwise(_spaces(F.col("norm")) - 1).cast("long"))
    norm = F.col("norm")
    places = []
    for phrase, label in BASE.items():
        cut = F.split(norm, f"(?<= ){phrase}(?= )")
        first = _spaces(F.get(cut, F.lit(0))) - 1
        last = F.col("n_words") - (_spaces(F.element_at(cut, -1)) - 1) - len(phrase.split())
        places.append(F.when(norm.contains(f" {phrase} "), F.struct(F.lit(label).alias("label"), (F.size(cut) - 1).cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))))
    literal = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(k).alias("keyword"), F.lit(f"(?<= ){p}(?= )").alias("pattern"), F.lit(n).alias("priority"), F.lit(levels.index(n)).alias("level")) for a, k, p, n in table_])
    maybe = F.lit(False)
    for stem in STEMS:
        maybe = maybe | F.contains(norm, F.lit(stem))
    there = F.filter(F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(f" {k[:-1]}" if k.endswith("*") else f" {k} ").alias("said")) for k in keywords]), lambda k: F.contains(norm, k["said"]))
    known = F.when(maybe, F.transform(there, lambda k: k["keyword"])).otherwise(F.array().cast("array<string>"))
    none = F.array().cast(FOUND)
    asked = lambda known_: F.filter(literal, lambda r: F.array_contains(known_, r["keyword"]))
    kept = let(known, lambda k: F.when(F.size(k) > 0, let(F.flatten(F.transform(asked(k), lambda r: _detections(norm, r))), lambda f: _kept(f, len(levels)))).otherwise(none))
    d = d.withColumn("base", F.array_compact(F.array(*places))).withColumn("kept", kept).drop("norm")
    base_labels = F.array_sort(F.transform("base", lambda b: b["label"]))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("kept", lambda k: k["label"]))))
    best = F.coalesce(F.array_max(F.transform("kept", lambda k: -k["priority"])), F.lit(0)) / 100.0
    return d.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).cast("double").alias("score"),
        F.transform("kept", lambda k: F.struct(k["label"].alias("label"), k["first"].alias("first"), (-k["stop"]).alias("stop"))).alias("detections"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
