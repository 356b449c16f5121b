"""Joins and selections over spans (half-open intervals) of documents, split by position inside a document."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rounds of local maxima after which what is left, chains of spans in order of their rank, is decided by document.
ROUNDS = 4


def _level(start: str, end: str) -> Column:
    """The power of two that a span's length doesn't exceed: it touches at most two cells of that width."""
    return F.length(F.bin(F.col(end) - F.col(start) - 1)) - F.when(F.col(end) - F.col(start) == 1, 1).otherwise(0)


def _cell(place: Column, level: Column) -> Column:
    return F.call_function("shiftright", place.cast("long"), level.cast("int"))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of spans that overlap, equal in the ``by`` columns: these, and each side's other columns, named l_ and r_.

    A span stands in the cells that it touches on a grid as wide as it is long, and is looked up by spans that are no
    longer, in the cells that these touch on that grid. So a pair shares a cell, and meets once: in that of its later
    start. Joins are by equal keys (document, grid, cell), so a document of very many spans is many keys, and
    spans that lie apart hardly meet. Empty spans, and such with a null end, overlap nothing; repeated rows stay."""
    named = lambda df, p: df.filter(F.col(start) < F.col(end)).select(*by, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by])
    a, b = named(left, "l"), named(right, "r")
    grid = {p: _level(f"{p}_{start}", f"{p}_{end}").cast("int") for p in "lr"}

    def cells(df: DataFrame, p: str, levels: Column) -> DataFrame:
        return df.withColumn("__level", levels).withColumn("__cell", F.explode(F.sequence(_cell(F.col(f"{p}_{start}"), F.col("__level")), _cell(F.col(f"{p}_{end}") - 1, F.col("__level")))))

    def met(long: DataFrame, p: str, short: DataFrame, q: str, strict: bool) -> DataFrame:
        known = sorted(r["level"] for r in long.select(grid[p].alias("level")).distinct().collect())  # at most 64
        above = F.filter(F.array(*[F.lit(x) for x in known]).cast("array<int>"), lambda x: x > grid[q] if strict else x >= grid[q])
        both = cells(long, p, grid[p]).join(cells(short, q, F.explode(above)), [*by, "__level", "__cell"])
        later = F.greatest(f"l_{start}", f"r_{start}")
        return both.filter((later < F.least(f"l_{end}", f"r_{end}")) & (_cell(later, F.col("__level")) == F.col("__cell"))).drop("__level", "__cell")

    return met(a, "l", b, "r", False).unionByName(met(b, "r", a, "l", True))


def chosen(rows: DataFrame, by: list[str], rank: list[str], conflict: Callable[[str, str], Column], start: str = "start", end: str = "end", rounds: int = ROUNDS) -> DataFrame:
    """The rows that a greedy choice keeps: in order of ``rank`` (ascending), a span is kept unless one that was kept conflicts
    with it. Only overlapping spans, equal in the ``by`` columns, may conflict; ``conflict("l_", "r_")`` says of two whether they do.

    Of equal spans (``by``, start, end) the first by rank stays; ranks and ends order all others. Rounds over the graph of
    conflicts decide: a span with no better one left is kept, and those in conflict with it go. With ranks in any order that
    ends in few rounds; what is left after ``rounds`` is decided by document, along its conflicts."""
    place = [*by, start, end]
    order = [*rank, start, end]
    others = [c for c in rows.columns if c not in place]
    whole = F.struct(*rank, *[c for c in others if c not in rank])
    rows_ = written(rows.filter(F.col(start) < F.col(end)).groupBy(*place).agg(F.min(whole).alias("__w")).select(*place, "__w.*").select(*rows.columns))
    pairs = overlapping(rows_, rows_, by, start, end)
    better = F.struct(*[f"l_{c}" for c in order]) < F.struct(*[F.col(f"r_{c}").alias(f"l_{c}") for c in order])
    ends = lambda p, name: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in (start, end)]).alias(name)
    edges = written(pairs.filter(better & conflict("l_", "r_")).select(*by, ends("l", "over"), ends("r", "under"), F.struct(*[F.col(f"l_{c}").alias(c) for c in order]).alias("lo"), F.struct(*[F.col(f"r_{c}").alias(c) for c in order]).alias("ro")))
    gone = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        beaten = edges.select(*by, F.col("under").alias("over")).distinct()
        top = edges.select(*by, "over").distinct().join(beaten, [*by, "over"], "left_anti")
        lost = written(edges.join(top, [*by, "over"], "left_semi").select(*by, "under").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        rest = edges.join(lost, [*by, "under"], "left_anti")
        edges = written(rest.join(lost.withColumnRenamed("under", "over"), [*by, "over"], "left_anti"))
    if not edges.isEmpty():
        gone = gone.unionByName(_rest(edges, by)) if gone is not None else _rest(edges, by)
    if gone is None:
        return rows_
    gone = gone.select(*by, f"under.{start}", f"under.{end}")
    return rows_.join(gone, place, "left_anti")


def _rest(edges: DataFrame, by: list[str]) -> DataFrame:
    """The losers among conflicts that rounds left open: each document's in order of rank."""
    lost = edges.select(*by, "under")

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        key = lambda x: tuple(x.values()) if isinstance(x, dict) else tuple(x)
        over, under = [key(x) for x in group["lo"]], [key(x) for x in group["ro"]]
        beats: dict[tuple, list] = {}
        span: dict[tuple, object] = {}
        for a, b, s in zip(over, under, group["under"]):
            beats.setdefault(a, []).append(b)
            span[b] = s
        out: dict[tuple, object] = {}
        for a in sorted({*over, *under}):
            if a not in out:
                out |= {b: span[b] for b in beats.get(a, ()) if b not in out}
        made = pd.DataFrame({c: [group[c].iloc[0]] * len(out) for c in by})
        made["under"] = list(out.values())
        return made

    return edges.groupBy(*by).applyInPandas(decide, lost.schema)
