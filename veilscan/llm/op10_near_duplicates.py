"""Near-duplicates: DartMinHash signatures, banded joining, exact checks, components.

A document's shingles fall into a fixed space of coordinates (SPACE), and a coordinate's weight is how many of them it
has: a sparse weighted set, bounded however long the text is. Its weighted Jaccard similarity is never below that of the
shingles themselves. Darts are thrown at the plane of each coordinate (weight across, rank upwards) by a hashed Poisson
process of density one, so equal coordinates get equal darts in every document. A document keeps the darts that fall
below the weight of their coordinate, and the earliest of each of ``k`` numbers makes its signature: two documents agree
in a number with the probability of their weighted similarity. Ranks are only searched up to about k(ln k + 2) darts a
document, however many elements it has; a document with an empty number is searched further.

Documents of equal shingles are one class at once and only their representative goes on. Representatives meet in bands:
in each bucket every member is paired with one, that of the smallest key, and pairs are checked by their exact common
shingles. What the components of these links leave apart inside a bucket is compared in full, in blocks of bounded size:
tasks multiply the incidence matrices of two blocks of members and send out links alone; each pair of blocks has a key
of its own. So no bucket is cut short and no pairs of a group are written out. Components of all links are the classes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, mix, removed, shingles, slices, small_batches, table, words, written

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 7
#: Coordinates of the weighted sets.
SPACE = 1 << 20
#: Bytes of text whose darts are thrown at a time.
BYTES = 1 << 19
#: Coordinates whose darts are thrown at once.
THROWN = 1 << 18
#: Members and shingles of a block of a bucket, and shingles that two blocks are compared by at a time.
BLOCK, ELEMENTS, COMPARED = 192, 1 << 16, 1 << 14
_STEP = np.uint64(0x9E3779B97F4A7C15)


def elements(texts: pa.Array, width: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in order, and the texts they belong to. ``counted``: the n-th of equal shingles is an element of its own, so that similarity weighs shingles by how often they stand."""
    e, d = shingles(*words(texts), width)
    order = np.lexsort((e, d))
    e, d = e[order], d[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    if not counted:
        return e[new], d[new]
    first = np.flatnonzero(new)
    nth = np.arange(len(e)) - np.repeat(first, np.diff(np.append(first, len(e))))
    e = np.where(nth > 0, mix(e + _STEP * nth.astype(np.uint64)), e)
    order = np.lexsort((e, d))
    return e[order], d[order]


def weighted(e: np.ndarray, doc: np.ndarray, space: int = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of each document's elements, the document, and the weight: how many elements a coordinate has."""
    place = mix(e + np.uint64(1)) % np.uint64(space)
    order = np.lexsort((place, doc))
    place, doc = place[order], doc[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return place[at], doc[at], np.diff(np.append(at, len(place))).astype(float)


def darts(coordinates: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """An (n, k) array of dart numbers; documents without elements have zeros. Weights may be any positive numbers."""
    none = np.iinfo(np.uint64).max
    best = np.full(n * k, none, np.uint64)
    total = np.bincount(doc, weight, n)
    reach = np.zeros(n)
    reach[total > 0] = k * (np.log(k) + 2) / total[total > 0]
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        for lo in range(0, len(mine), THROWN):
            own = mine[lo : lo + THROWN]
            _throw(best, coordinates[own], doc[own], weight[own], reach, k)
        todo &= (best.reshape(n, k) == none).any(1)
        reach *= 2
    got = (best & np.uint64(0xFFFFFFFF)).reshape(n, k)
    got[total == 0] = 0
    return got


def _throw(best: np.ndarray, e: np.ndarray, d: np.ndarray, w: np.ndarray, reach: np.ndarray, k: int) -> None:
    cells = np.ceil(w).astype(np.int64)  # unit cells of weight; each has its own process of darts
    row = np.repeat(np.arange(len(e)), cells)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mix(e[row] + _STEP * (cell.astype(np.uint64) + np.uint64(1)))
    rank, step, chunk = np.zeros(len(row)), 0, 1
    while len(row):
        h = mix(seed[:, None] + _STEP * np.arange(step + 1, step + chunk + 1, dtype=np.uint64))
        ranks = rank[:, None] - np.cumsum(np.log1p(-((h >> np.uint64(11)).astype(float) * 2.0**-53)), 1)
        i, j = np.nonzero(ranks <= reach[d[row]][:, None])
        if len(i):
            g = mix(h[i, j])
            part = w[row[i]] - cell[i] < 1  # a cell that the weight doesn't fill
            if part.any():
                place = cell[i] + (mix(g) >> np.uint64(11)).astype(float) * 2.0**-53
                hit = place < w[row[i]]
                i, j, g = i[hit], j[hit], g[hit]
            packed = (ranks[i, j].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32))
            np.minimum.at(best, d[row[i]] * k + (g % np.uint64(k)).astype(np.int64), packed)
        on = ranks[:, -1] <= reach[d[row]]
        row, cell, seed, rank = row[on], cell[on], seed[on], ranks[on, -1]
        step, chunk = step + chunk, min(64, chunk * 4)


def signature(width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, counted: bool = False):
    """A column function: a text's key (equal for equal elements) and band hashes; null where it has no word."""
    k = bands * rows

    @arrow_udf("struct<key:binary,bands:array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        keys, banded = [], []
        for part in slices(texts, BYTES):
            n = len(part)
            e, d = elements(part, width, counted)
            got = darts(*weighted(e, d), n, k)
            folded = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for r in range(rows):
                folded = mix(folded * _STEP + got[:, r::rows])
            some = np.bincount(d, minlength=n) > 0
            pairs = set_keys(e, d, n)
            keys += [pairs[i].tobytes() if some[i] else None for i in range(n)]
            banded += [x if s else None for x, s in zip(folded.view(np.int64), some)]
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], ["key", "bands"])

    return sign


def set_keys(e: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, 2) sums over each document's elements: equal for equal sets, whatever their order."""
    ends = np.searchsorted(doc, np.arange(n + 1))
    out = np.zeros((n, 2), np.uint64)
    for i in (0, 1):
        run = np.append(np.zeros(1, np.uint64), np.cumsum(mix(e * np.uint64(2 * i + 3) + np.uint64(1))))
        out[:, i] = run[ends[1:]] - run[ends[:-1]]
    return out


def shingle_sets(width: int = WIDTH, counted: bool = False):
    """A function of batches (key, text): (key, elements of the text), a bounded run of texts at a time; texts whose key is another go."""

    def sets(batches):
        for batch in batches:
            keys, lo = batch.column(0), 0
            for part in slices(batch.column(1), BYTES):
                e, d = elements(part, width, counted)
                own, mine = set_keys(e, d, len(part)), keys.slice(lo, len(part))
                ends = np.searchsorted(d, np.arange(len(part) + 1))
                same = pa.array([own[i].tobytes() == k for i, k in enumerate(mine.to_pylist())], pa.bool_())
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(e.view(np.int64)))
                yield pa.RecordBatch.from_arrays([mine.filter(same), found.filter(same)], ["key", "set"])
                lo += len(part)

    return sets


def block_links(similarity: float):
    """A column function of two blocks of members (key, label, set): pairs of keys of different labels whose sets are similar enough."""
    kind = "array<struct<a:binary,b:binary>>"

    def unpacked(members: pa.StructArray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        sets = members.field("set")
        ends = sets.offsets.to_numpy()
        return members.field("key").to_pylist(), np.array(members.field("label").to_pylist(), object), np.diff(ends), sets.values.to_numpy()[ends[0] : ends[-1]]

    @arrow_udf(kind)
    def links(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for i in range(len(left)):
            (ka, la, na, sa), (kb, lb, nb, sb) = (unpacked(x[i].values) for x in (left, right))
            # only elements on both sides can be common
            common = np.intersect1d(sa, sb)
            shared = np.zeros((len(na), len(nb)), np.float32)
            who = [np.repeat(np.arange(len(n)), n) for n in (na, nb)]
            for lo in range(0, len(common), COMPARED):
                some, rows = common[lo : lo + COMPARED], []
                for s, w, n in ((sa, who[0], na), (sb, who[1], nb)):
                    at = np.searchsorted(some, s)
                    at[at == len(some)] = 0
                    hit = some[at] == s
                    m = np.zeros((len(n), len(some)), np.float32)
                    m[w[hit], at[hit]] = 1
                    rows.append(m)
                shared += rows[0] @ rows[1].T
            close = (shared >= similarity * (na[:, None] + nb[None, :] - shared) - 1e-6) & (la[:, None] != lb[None, :])
            out.append([{"a": min(ka[x], kb[y]), "b": max(ka[x], kb[y])} for x, y in zip(*np.nonzero(close))])
        return pa.array(out, pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())])))

    return links


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each connected component of edges (a, b). Labels spread to neighbours and then jump to their label's label, each round as a written table."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.key).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.key == near.a).select("key", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("far"))
        step = written(step.join(jump, "next", "left").select("key", F.col("label").alias("was"), F.least("next", F.coalesce("far", "next")).alias("label")))
        removed(labels)
        labels = step
        if not step.filter("was <> label").limit(1).count():
            removed(both)
            return labels.select("key", "label")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps count by their JSON."""
    return F.xxhash64(F.lit(1), *[F.to_json(df[f"`{n}`"]) if kind.startswith("map") else df[f"`{n}`"] for n, kind in df.dtypes])


def _classed(docs: DataFrame, doc_id: str, text: str, width: int, similarity: float, bands: int, rows: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, h, key) of ``docs``, key null without a word, and (key, label, class_id, class_rows) of all keys.

    ``t`` and ``h`` are hashes of the text and of the whole row."""
    signed = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("t"), row_hash(docs).alias("h"), signature(width, bands, rows, counted)(docs[text]).alias("s"))
    with small_batches(docs.sparkSession):
        signed = written(signed.select("doc_id", "t", "h", "s.key", "s.bands"))
    # a key's rows have the same bands; its text is that of its first row: the smallest doc_id, null last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    reps = written(signed.filter("key is not null").groupBy("key").agg(first, F.count("*").alias("n"), F.first("bands").alias("bands")))
    sets = reps.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.t").alias("t"), "n")
    members = reps.select("key", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("hub")).filter("size > 1").drop("size")
    members = written(members.join(buckets, "bucket"))

    pairs = written(members.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    whole = _sets(wanted, sets, docs, doc_id, text, width, counted)
    links = written(_hub_links(pairs, whole, similarity))
    removed(pairs)
    labels = components(links)

    # buckets that the components leave apart: everyone outside a bucket's main component meets all the others, in blocks
    placed = members.select("bucket", "key").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    parts = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    apart = placed.join(main, "bucket").withColumn("inner", F.col("label") == F.col("main")).select("bucket", "inner", "key", "label")
    apart = written(apart.join(whole.select("key", "set"), "key"))
    with small_batches(docs.sparkSession):
        more = written(_compared(apart, similarity))
    removed(members, whole, apart)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    removed(links, more)

    grouped = sets.join(labels, "key", "left").select("key", "first_id", "n", F.coalesce("label", "key").alias("label"))
    classes = grouped.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_rows"))
    return signed.drop("bands"), grouped.select("key", "label").join(classes, "label")


def _hub_links(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a hub and a member whose sets (key, set) are similar enough: members go to their hubs in blocks of bounded
    size, and a hub's set is sent once for each block."""
    sized = pairs.join(whole.select(F.col("key").alias("b"), F.size("set").alias("size")), "b")
    blocks = sized.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / ELEMENTS)).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    block = dealt.join(whole.withColumnsRenamed({"key": "b", "set": "y"}), "b").groupBy("a", "block").agg(F.collect_list(F.struct("b", "y")).alias("members"))
    hubs = whole.withColumnsRenamed({"key": "a", "set": "x"})

    def close(m: Column) -> Column:
        common = F.size(F.array_intersect(F.col("x"), m["y"]))
        return common >= F.lit(similarity) * (F.size("x") + F.size(m["y"]) - common) - F.lit(1e-6)

    return block.join(hubs, "a").select("a", F.explode(F.transform(F.filter("members", close), lambda m: m["b"])).alias("b"))


def _compared(apart: DataFrame, similarity: float) -> DataFrame:
    """Links between members (bucket, inner, key, label, set) of a bucket of which one isn't of the main component; blocks are keyed by pair."""
    sizes = apart.groupBy("bucket", "inner").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("set")) / ELEMENTS)).alias("blocks"))
    sizes = sizes.groupBy("bucket").agg(*[F.coalesce(F.max(F.when(F.col("inner") == x, F.col("blocks"))), F.lit(0)).alias(n) for n, x in (("inside", True), ("outside", False))])
    rows = apart.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("inner"), F.col("inside")).otherwise(F.col("outside"))))
    block = rows.groupBy("bucket", "inner", "block", "inside", "outside").agg(F.collect_list(F.struct("key", "label", "set")).alias("members"))
    target = lambda inner, first, n: F.when(n > first, F.transform(F.sequence(first, n - 1), lambda i: F.struct(F.lit(inner).alias("inner"), i.alias("block")))).otherwise(F.array().cast("array<struct<inner:boolean,block:bigint>>"))
    meets = F.concat(target(False, F.col("block"), F.col("outside")), target(True, F.lit(0).cast("long"), F.col("inside")))
    left = block.filter(~F.col("inner")).select("bucket", F.col("members").alias("left"), F.explode(meets).alias("m")).select("bucket", "m.*", "left")
    right = block.select("bucket", "inner", "block", F.col("members").alias("right"))
    both = left.join(right, ["bucket", "inner", "block"])
    return both.select(F.explode(block_links(similarity)("left", "right")).alias("p")).select("p.a", "p.b").distinct()


def _sets(keys: DataFrame, sets: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, counted: bool) -> DataFrame:
    """The elements of keys, from the texts of their first rows."""
    named = keys.join(sets.select("key", "first_id", "t"), "key")
    texts = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("t"))
    found = texts.join(named, (texts["t"] == named["t"]) & texts["id"].eqNullSafe(named["first_id"]))
    # equal hashes may be of other texts, of other keys; a repeated row is the same set
    with small_batches(docs.sparkSession):
        return written(found.select("key", texts["text"]).mapInArrow(shingle_sets(width, counted), "key binary, set array<bigint>").dropDuplicates(["key"]))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id (the smallest doc_id of its class) and the class's number of rows.

    Linked are rows whose sets of ``width``-word shingles have a Jaccard similarity of at least ``similarity`` (with
    ``counted``, multisets); classes are the components. A text of fewer words is one shingle. A text without a word
    (null, empty) is a class of its own row. Repeated rows are of one class, as are rows that repeat a doc_id with a
    near text. A row without doc_id is linked like others; a class that has no doc_id has a null class_id. A very long
    text is compared whole. There are no ties: a class has one smallest id. Other columns are not carried, whatever
    their names; an empty table gives no rows."""
    signed, classes = _classed(docs, doc_id, text, width, similarity, bands, rows, counted)
    named = signed.select("doc_id", "key").join(classes.select("key", "class_id", "class_rows"), "key", "left")
    return named.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """One row of each class of ``docs``, with all its columns: that of the smallest doc_id (null last); of rows that
    repeat it, that of the smallest hash of text and row, of rows that are equal in everything, one. Rows without a
    word are all kept. An empty table stays empty."""
    signed, classes = _classed(docs, doc_id, text, width, similarity, bands, rows, counted)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "h")).alias("best")
    kept = signed.join(classes.select("key", "label"), "key").groupBy("label").agg(best).select("best.t", "best.h")
    t, h = fresh(docs, "__t"), fresh(docs, "__h")
    rows_ = docs.withColumn(h, row_hash(docs)).withColumn(t, F.xxhash64(docs[text]))
    worded = F.coalesce(docs[text], F.lit("")).rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")
    one = rows_.filter(worded).join(kept.select(F.col("t").alias(t), F.col("h").alias(h)), [t, h], "left_semi").dropDuplicates([t, h])
    return one.unionByName(rows_.filter(~worded)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
