"""Array expressions whose work is in proportion to their input."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold joins one by one; folds over folds take the rest.
STEP = 128

SPANS = "array<struct<start:int,end:int>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once. An expression put into a lambda directly would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(xs: Column) -> Column:
    """An array in pieces of STEP elements."""
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(STEP)), lambda i: F.slice(xs, i, F.lit(STEP))))


def placed(sizes: Column) -> Column:
    """Spans (start, end) of things of sizes (gap, own) that stand in a row: running sums, inside pieces and then over pieces."""
    none = F.array().cast(SPANS)
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["own"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    def moved(pieces: Column) -> Column:
        bases = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(pieces, bases, lambda p, b: F.transform(p["out"], lambda s: F.struct((s["start"] + b).alias("start"), (s["end"] + b).alias("end")))))

    whole = lambda xs: let(F.transform(blocks(xs), lambda piece: F.aggregate(piece, begin, one)), moved)
    return let(sizes, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def tops_before(xs: Column) -> Column:
    """For each number of an array the largest before it (null for the first): running maxima, inside pieces and then over pieces."""
    empty = F.array().cast("array<int>")
    begin = F.struct(F.lit(None).cast("int").alias("top"), empty.alias("out"))
    one = lambda acc, x: F.struct(F.greatest(acc["top"], x).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out"))
    over = lambda acc, p: F.struct(F.greatest(acc["top"], p["top"]).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out"))

    def lifted(pieces: Column) -> Column:
        return F.flatten(F.zip_with(pieces, F.aggregate(pieces, begin, over)["out"], lambda p, top: F.transform(p["out"], lambda x: F.greatest(x, top))))

    return F.when(F.size(xs) > 0, let(F.transform(blocks(xs), lambda piece: F.aggregate(piece, begin, one)), lifted)).otherwise(empty)


def clusters(spans: Column) -> Column:
    """An array of spans in order of start, cut where none reaches over: spans of different pieces don't overlap."""

    def cut(xs: Column) -> Column:
        tops = tops_before(F.transform(xs, lambda s: s["end"]))
        heads = F.filter(F.zip_with(tops, F.transform(xs, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"))), lambda top, s: F.when(top.isNull() | (s["start"] >= top), s["i"] + 1)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda i, k: F.slice(xs, i, F.coalesce(F.get(h, k + 1), F.size(xs) + 1) - i)))

    return F.when(F.size(spans) > 0, let(spans, cut)).otherwise(F.slice(F.array(spans), 1, 0))


def matches(text: Column, pattern: str | Column, size=F.length) -> Column:
    """Matches of a pattern in order: raw, start, end; ``size`` measures text. The pattern runs twice over the text, however many matches there are."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("found"), F.split(text, regex, -1).alias("between"))

    def made(v: Column) -> Column:
        sizes = F.zip_with(v["found"], F.slice(v["between"], 1, F.size(v["found"])), lambda f, b: F.struct(size(b).alias("gap"), size(f).alias("own")))
        return F.zip_with(v["found"], placed(sizes), lambda f, s: F.struct(f.alias("raw"), s["start"].alias("start"), s["end"].alias("end")))

    return let(both, made)
