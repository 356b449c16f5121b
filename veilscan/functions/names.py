"""Names as sets of tokens, with initials."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import COMMON_NAMES, HONORIFICS
from ..sources.scratch import written
from .arrays import let

#: Letters with marks and the letters without, in equal places.
MARKED = "áàâäãåāăąéèêëēėęěíìîïīįıóòôöõōőúùûüūůűçćčñńňýÿšśžźżďťřłđğ"
PLAIN = "aaaaaaaaaeeeeeeeeiiiiiiiooooooouuuuuuucccnnnyysszzzdtrldg"


def tokens(name: Column) -> Column:
    """Lower-case tokens without marks, punctuation and titles (titles stay if nothing else is there). Null gives none."""
    x = F.translate(F.lower(F.coalesce(name, F.lit(""))), MARKED, PLAIN)
    x = F.regexp_replace(F.regexp_replace(x, r"[.\-_/\\,;:()@#\[\]{}]", " "), r"[^a-z0-9\s]", "")
    raw = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    kept = F.filter(raw, lambda t: ~t.isin(*HONORIFICS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def _pairs(a: Column, b: Column) -> Column:
    """Each token of a takes the first free equal one of b; then free tokens pair with initials: used places and pair counts."""
    state = "struct<a:array<int>,b:array<int>,exact:int,initial:int>"
    start = F.struct(F.array().cast("array<int>").alias("a"), F.array().cast("array<int>").alias("b"), F.lit(0).alias("exact"), F.lit(0).alias("initial")).cast(state)
    places = F.transform(a, lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("x")))
    others = F.transform(b, lambda y, j: F.struct(j.cast("int").alias("j"), y.alias("y")))

    def one(kind: str):
        def fits(x: Column, y: Column) -> Column:
            if kind == "exact":
                return x == y
            return ((F.length(x) == 1) & (F.length(y) > 1) & y.startswith(x)) | ((F.length(y) == 1) & (F.length(x) > 1) & x.startswith(y))

        def step(acc: Column, p: Column) -> Column:
            free = F.filter(others, lambda o: ~F.array_contains(acc["b"], o["j"]) & fits(p["x"], o["y"]))
            took = (F.size(free) > 0) & ~F.array_contains(acc["a"], p["i"])
            counts = [(acc[k] + (1 if k == kind else 0)).alias(k) for k in ("exact", "initial")]
            more = F.struct(F.concat(acc["a"], F.array(p["i"])).alias("a"), F.concat(acc["b"], F.array(F.get(free, 0)["j"])).alias("b"), *counts)
            return F.when(took, more).otherwise(acc).cast(state)

        return step

    return F.aggregate(places, F.aggregate(places, start, one("exact")), one("initial"))


def compare(a: Column, b: Column) -> Column:
    """Of two token arrays: similarity (weight of pairs over the longer length), is_match, match_type."""
    return let(_pairs(a, b), lambda p: _judged(a, b, p))


def unmatched(a: Column, b: Column) -> Column:
    """Of two token arrays the tokens of each that have no partner, by place: of a repeated token one may have a partner."""
    free = lambda xs, used: F.filter(xs, lambda x, i: ~F.array_contains(used, i))
    return let(_pairs(a, b), lambda p: F.struct(free(a, p["a"]).alias("a"), free(b, p["b"]).alias("b")))


def _judged(a: Column, b: Column, p: Column) -> Column:
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    matched = p["exact"] + p["initial"]
    score = (p["exact"] * F.lit(100) + p["initial"] * F.lit(85)) / longer
    lone = (shorter == 1) & (longer > 1) & (matched == 1) & (p["initial"] == 1)
    match = (shorter > 0) & (((matched >= shorter) & ~lone) | (score >= 70))
    kind = F.when(~match, "NO_MATCH").when((matched == longer) & (p["initial"] == 0), "EXACT").when(p["initial"] > 0, "INITIALS_EXPANSION").otherwise("PARTIAL")
    similarity = F.when(longer > 0, F.floor(score + 0.5) / 100).otherwise(F.lit(0.0))
    return F.struct(F.coalesce(similarity, F.lit(0.0)).alias("similarity"), match.alias("is_match"), kind.alias("match_type"))


def is_common(t: Column) -> Column:
    """At least two common tokens besides initials, or the only one is."""
    long = F.filter(t, lambda x: F.length(x) > 1)
    common = F.size(F.filter(long, lambda x: x.isin(*COMMON_NAMES)))
    return (F.size(long) > 0) & F.when(F.size(long) >= 2, common >= 2).otherwise(common == F.size(long))


#: Names that share a key beyond which it is dealt over parts.
HOT = 10_000


def _keys(token: Column, full: Column | bool) -> Column:
    """What a token is found by: itself, and a letter. Of a side that is looked up in (``full``) an initial stands under
    ``i``, a longer token's first letter under ``f``; the side that looks asks an initial at ``f``, a longer token at ``i``."""
    initial = F.length(token) == 1
    mark = F.when(initial == F.lit(full), "i:").otherwise("f:")
    return F.array(F.concat(F.lit("w:"), token), F.concat(mark, F.left(token, F.lit(1))))


def _looked_up(asking: DataFrame, other: DataFrame, tokens_: str, other_tokens: str, asked: Column, more: Column) -> DataFrame:
    """(tokens_, other_tokens) pairs that may match, found by the ``asked`` rarest tokens of each list of one side.

    How rare a token is says the number of lists of the other side that its keys lead to."""
    full = other.select(other_tokens, F.explode(F.array_distinct(F.flatten(F.transform(other_tokens, lambda t: _keys(t, True))))).alias("key"))
    n_lists = full.groupBy("key").agg(F.count("*").alias("lists"))
    each = asking.select(tokens_, F.explode(F.array_distinct(F.col(tokens_))).alias("token")).withColumn("key", F.explode(_keys(F.col("token"), False)))
    cost = each.join(n_lists, "key").groupBy(tokens_, "token").agg(F.sum("lists").alias("cost"))
    # a token that leads nowhere is the rarest: it can't be among the matched ones, so it takes a place
    tried = each.select(tokens_, "token").distinct().join(cost, [tokens_, "token"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "token")))
    rare = tried.groupBy(tokens_).agg(order.alias("order")).select(tokens_, F.explode(F.slice("order", F.lit(1), asked)).alias("o")).filter("o.cost > 0")
    asks = rare.select(tokens_, F.explode(_keys(F.col("o.token"), False)).alias("key"))
    # keys of very many lists are dealt over parts on the side with many rows, and asked in every part
    hot = F.broadcast(n_lists.filter(F.col("lists") > HOT).select("key", F.ceil(F.col("lists") / HOT).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    asks = asks.join(hot, "key", "left").select(tokens_, "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    full = full.join(hot, "key", "left").select(other_tokens, "key", F.pmod(F.xxhash64(other_tokens), parts).alias("part"))
    return asks.join(full, ["key", "part"]).filter(more).select(tokens_, other_tokens)


def _matched(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of both sides with their token lists, and the pairs of distinct lists that match."""
    rows = {}
    for side, df, id_, name in (("left", left, left_id, left_name), ("right", right, right_id, right_name)):
        rows[side] = written(df.select(df[id_].alias(f"{side}_id"), tokens(df[name]).alias(f"{side}_tokens")).filter(F.size(f"{side}_tokens") > 0))
    lists = {side: rows[side].select(f"{side}_tokens").distinct() for side in rows}
    n = F.size("left_tokens")
    spare = (n - F.floor((n * 7 + 9) / 10) + 1).cast("int")
    longer = F.size("left_tokens") > F.size("right_tokens")
    found = _looked_up(lists["left"], lists["right"], "left_tokens", "right_tokens", spare, F.lit(True))
    found = found.unionByName(_looked_up(lists["right"], lists["left"], "right_tokens", "left_tokens", F.lit(1), longer)).distinct()
    m = found.withColumn("m", compare(F.col("left_tokens"), F.col("right_tokens"))).filter("m.is_match")
    return rows, m.select("left_tokens", "right_tokens", "m.similarity", "m.match_type")


#: Ids in a block of rows of one name; pairs of ids in a task, and most tasks that they are dealt over.
BLOCK, TASK, TASKS = 1024, 500_000, 5_000


def _blocks(rows: DataFrame, counted: DataFrame, side: str) -> DataFrame:
    """The ids of each token list in blocks of about BLOCK."""
    tokens_ = f"{side}_tokens"
    hot = F.broadcast(counted.filter(F.col(f"{side}_n") > BLOCK).select(tokens_, F.ceil(F.col(f"{side}_n") / BLOCK).alias("parts")))
    part = F.pmod(F.xxhash64(f"{side}_id"), F.coalesce("parts", F.lit(1))).alias("part")
    return rows.join(hot, tokens_, "left").groupBy(tokens_, part).agg(F.collect_list(f"{side}_id").alias(f"{side}_ids")).drop("part")


def matches(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str) -> DataFrame:
    """Pairs whose names match, found by their rarest tokens.

    A match pairs all tokens of the shorter name, or at least 0.7 of the longer one's. So of n tokens of a name as long
    as the other, or longer in the second case, at most n - ceil(0.7 n) have no partner: one of one more than that, the
    rarest ones, leads to the other name, as itself or by an initial. If the other name is the shorter, its rarest token does.
    A token that a third of all names have is asked for only where a name has no rarer one. Distinct token lists are
    compared, not rows; ids join back last. Names without tokens match nothing.

    Ids come back in blocks: pairs of names that very many rows have are spread over tasks by pairs of blocks, a number of
    tasks in proportion to the pairs that there are."""
    rows, m = _matched(left, right, left_id, left_name, right_id, right_name)
    m = written(m)
    counted = {side: rows[side].groupBy(f"{side}_tokens").agg(F.count("*").alias(f"{side}_n")) for side in rows}
    n_pairs = m.join(counted["left"], "left_tokens").join(counted["right"], "right_tokens").agg(F.sum(F.col("left_n").cast("double") * F.col("right_n"))).first()[0] or 0
    met = m.join(_blocks(rows["left"], counted["left"], "left"), "left_tokens").join(_blocks(rows["right"], counted["right"], "right"), "right_tokens")
    met = met.select("left_ids", "right_ids", "similarity", "match_type")
    if n_pairs > TASK:
        met = met.repartition(min(int(n_pairs // TASK) + 1, TASKS))
    met = met.select(F.explode("left_ids").alias("left_id"), "right_ids", "similarity", "match_type")
    return met.select("left_id", F.explode("right_ids").alias("right_id"), "similarity", "match_type")


def best(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str) -> DataFrame:
    """Of the ``matches`` of each left id the most similar one; ties go to the smaller right id. It is chosen by token
    list, of each of which only the smallest id can win, so pairs of rows are never made."""
    rows, m = _matched(left, right, left_id, left_name, right_id, right_name)
    least = rows["right"].groupBy("right_tokens").agg(F.min("right_id").alias("right_id"))
    first = F.min(F.struct((-F.col("similarity")).alias("loss"), "right_id", "match_type")).alias("b")
    top = m.join(least, "right_tokens").groupBy("left_tokens").agg(first)
    found = rows["left"].join(top, "left_tokens").groupBy("left_id").agg(F.min("b").alias("b"))
    return found.select("left_id", "b.right_id", (-F.col("b.loss")).alias("similarity"), "b.match_type")
