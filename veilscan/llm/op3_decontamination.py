"""Benchmark decontamination with suffix arrays over shards of the training text.

Every run of texts of an Arrow batch is a shard: its words become numbers of the benchmark's vocabulary, and the
suffixes that could hold a test window (all of its words are benchmark words) are sorted by their first words: the
shard's suffix array. Every distinct test suffix is looked up there by binary search. The ranges found give the places
of test windows; at these places the test suffixes that begin there are extended word by word to the longest verbatim
match. A document keeps the matches that cover its hit words, each the longest at its place. Words matched by hash are
compared as bytes before they count.

A place of the shard has at most one window of each size, and a set of items stands once, so memory is linear in the
text, the benchmark block and the result, however often a line repeats on either side.

The benchmark is the stated query set. A small one is one broadcast. A larger one is searched in blocks of bounded text,
one after another: a block's results are written and its broadcast is released before the next. No document is shuffled
to be searched, and none is collected.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import broadcast_if_small, fresh, held, lower_bytes, slices, table, word_spans, words, written

WINDOW = 10
#: Bytes of benchmark text of one block; an item is never split.
BLOCK_BYTES = 4 << 20

SPANS = "array<struct<first:bigint,stop:bigint>>"
MATCHES = "array<struct<item:string,item_word:bigint,doc_word:bigint,length:bigint>>"
FOUND = f"struct<n_words:bigint,spans:{SPANS},items:array<string>,matches:{MATCHES}>"
_SPAN = pa.struct([("first", pa.int64()), ("stop", pa.int64())])
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())])


class Words:
    """Words of texts: hashes, offsets of texts, and the bytes of any word."""

    def __init__(self, texts: pa.Array):
        self.hashes, self.at, (self.data, self.begin, self.stop) = word_spans(texts)

    def spelled(self, first: int, n: int) -> list[bytes]:
        lo = int(self.begin[first])
        low = lower_bytes(self.data[lo : self.stop[first + n - 1]]).tobytes()
        return [low[a - lo : b - lo] for a, b in zip(self.begin[first : first + n].tolist(), self.stop[first : first + n].tolist())]


class Suffixes:
    """The distinct windows of a block of items, as keys of numbers of the block's vocabulary, with all their places."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.window, self.ids = window, ids
        self.words = Words(pa.array(texts, pa.large_string()))
        at = self.words.at
        self.vocabulary = np.unique(self.words.hashes)
        self.short = np.zeros(1 << 20, bool)
        self.short[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.numbers = np.append((np.searchsorted(self.vocabulary, self.words.hashes) + 1).astype(np.uint32), np.uint32(0))
        n = np.diff(at)
        windows = np.maximum(n - window + 1, np.minimum(n, 1))  # a shorter item is one window
        item = np.repeat(np.arange(len(n)), windows)
        place = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows) + at[item]
        size = np.minimum(window, n[item])
        self.item_of = np.repeat(np.arange(len(n)), n)
        self.item_end = at[1:][self.item_of] if len(self.item_of) else self.item_of
        self.least = int(size.min(initial=window))
        key = self._keys(self.numbers, place, size)
        by_size = np.lexsort((place, key, size)) if len(place) else np.zeros(0, np.int64)
        key, size, self.places = key[by_size], size[by_size], place[by_size]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1])
        self.first = np.append(np.flatnonzero(new), len(key))  # the places of window w: from first[w] to first[w + 1]
        self.low, self.size = key[new], size[new]
        self.short_window = np.flatnonzero(self.size < window)
        self.high = self._keys(self.numbers, self.places[self.first[:-1][self.short_window]], self.size[self.short_window], 0xFFFFFFFF)
        self._sets(item[by_size])

    def _keys(self, numbers: np.ndarray, place: np.ndarray, room: np.ndarray, beyond: int = 0) -> np.ndarray:
        """The first words from each place, as bytes that sort as the numbers do; words beyond ``room`` are ``beyond``."""
        out = np.full((len(place), self.window), beyond, ">u4")
        for j in range(self.window):
            there = room > j
            out[there, j] = numbers[place[there] + j]
        return out.view(f"S{4 * self.window}").ravel() if len(place) else np.zeros(0, f"S{4 * self.window}")

    def _sets(self, item: np.ndarray) -> None:
        """The items of each window: windows with the same items have the same set."""
        known: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.set_of = np.zeros(len(self.low), np.int64)
        bounds = self.first.tolist()
        for w, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            own = item[lo:hi] if hi - lo == 1 else np.unique(item[lo:hi])
            k = known.setdefault(own.tobytes(), len(known))
            if k == len(self.sets):
                self.sets.append(own)
            self.set_of[w] = k

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the vocabulary from 1; 0 for a word that isn't in it."""
        out = np.zeros(len(hashes), np.uint32)
        maybe = np.flatnonzero(self.short[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        out[maybe[same]] = at[same] + 1
        return out

    def hits(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, window) of each window found, in order of place and then of size."""
        none = np.zeros(0, np.int64)
        n = len(numbers)
        if not len(self.low) or not n:
            return none, none
        # the benchmark words that follow in a row, up to the end of the text
        stops = np.zeros(n + 1, bool)
        stops[at[1:]] = True
        stops[np.flatnonzero(numbers == 0)] = True
        ends = np.flatnonzero(stops)
        heads = np.concatenate([[0], np.minimum(ends + (numbers[np.minimum(ends, n - 1)] == 0), n)])[: len(ends)]
        long = np.flatnonzero(ends - heads >= self.least)
        if not len(long):
            return none, none
        counts = (ends - heads)[long] - self.least + 1
        place = np.repeat(heads[long] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        keys = self._keys(numbers, place, np.repeat(ends[long], counts) - place)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        keys = keys[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.low, "right")
        hi[self.short_window] = np.searchsorted(keys, self.high, "right")
        found = hi - lo
        window = np.repeat(np.arange(len(found)), found)
        inside = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        place = place[order[np.repeat(lo, found) + inside]]
        order = np.lexsort((self.size[window], place))
        return place[order], window[order]

    def longest(self, numbers: np.ndarray, place: int, end: int, window: int) -> tuple[int, int]:
        """The place in the block and the length of the longest match of a shard's words from ``place``, where ``window`` stands."""
        alive, n = self.places[self.first[window] : self.first[window + 1]], int(self.size[window])
        while place + n < end:
            more = alive[(self.numbers[alive + n] == numbers[place + n]) & (self.item_end[alive] > alive + n)]
            if not len(more):
                break
            alive, n = more, n + 1
        return int(alive[0]), n

    def search(self, texts: pa.Array) -> tuple[list[int], dict[int, tuple[list, list, list]]]:
        """The number of words of each text, and (spans, items, matches) of those that have a hit."""
        shard = Words(texts)
        numbers, at = self.numbered(shard.hashes), shard.at
        while True:
            place, window = self.hits(numbers, at)
            out, wrong = {}, []
            doc = np.searchsorted(at, place, "right") - 1
            cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=len(at)))
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                d = int(doc[lo])
                matches, bad = self._matches(shard, numbers, place[lo:hi], window[lo:hi], int(at[d + 1]))
                wrong += bad
                sets = np.unique(self.set_of[window[lo:hi]])
                items = sorted({self.ids[i] for s in sets.tolist() for i in self.sets[s].tolist()})
                ends = np.maximum.accumulate(place[lo:hi] + self.size[window[lo:hi]])
                new = np.flatnonzero(np.append(True, place[lo + 1 : hi] > ends[:-1]))
                spans = zip((place[lo:hi][new] - at[d]).tolist(), (ends[np.append(new[1:], hi - lo) - 1] - at[d]).tolist())
                out[d] = ([{"first": a, "stop": b} for a, b in spans], items, [m | {"doc_word": m["doc_word"] - int(at[d])} for m in matches])
            if not wrong:
                return np.diff(at).tolist(), out
            numbers[wrong] = 0  # equal hashes of different words: these aren't benchmark words

    def _matches(self, shard: Words, numbers: np.ndarray, place: np.ndarray, window: np.ndarray, end: int) -> tuple[list[dict], list[int]]:
        """Longest matches that cover a document's hit words, and the places of words that are others than their hashes say."""
        last = np.append(place[1:] != place[:-1], True)  # of a place's windows the largest
        place, window = place[last], window[last]
        reach = place + self.size[window]
        out, wrong, k = [], [], 0
        while k < len(place):
            p = int(place[k])
            where, n = self.longest(numbers, p, end, int(window[k]))
            item = int(self.item_of[where])
            here, there = shard.spelled(p, n), self.words.spelled(where, n)
            wrong += [p + j for j in range(n) if here[j] != there[j]] if here != there else []
            out.append({"item": self.ids[item], "item_word": where - int(self.words.at[item]), "doc_word": p, "length": n})
            stop = p + n
            after = int(np.searchsorted(place, stop, "right"))  # windows that begin inside or right after the match
            near = np.arange(max(k + 1, int(np.searchsorted(place, stop - self.window, "left"))), after)
            best = int(near[np.argmax(reach[near])]) if len(near) else 0
            k = best if len(near) and reach[best] > stop else after
        return out, wrong


def _search(shared, window: int):
    @arrow_udf(FOUND)
    def search(texts: pa.Array) -> pa.Array:
        ready = held("suffixes")
        if ready.get("of") is not shared.value:  # a worker's next task of the same block finds it here
            ready |= {"of": shared.value, "index": Suffixes(*shared.value, window)}
        counts, found = [], []
        for part in slices(texts):
            n, some = ready["index"].search(part)
            counts += n
            found += [some.get(i, ((), (), ())) for i in range(len(part))]
        spans, items, matches = ([x[k] for x in found] for k in range(3))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(_MATCH))], ["n_words", "spans", "items", "matches"])

    return search


def word_count():
    """A column function: the number of words of a text."""

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(words(part)[1]) for part in slices(texts))]))

    return count


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "leak") -> DataFrame:
    """``docs`` with a struct column ``into`` (it takes the place of a column of that name): ``n_words``, the ``spans`` of hit
    words, the ``items`` that have a window there, and ``matches``, the longest verbatim ones, which cover the spans.

    A null or empty text has no words and no match; so has every text if the benchmark is empty. A very long text is
    searched whole, with memory in proportion. A null item id is the empty id. Of equally long matches at a place (ties)
    the first item's is given. Repeated rows are each searched; other columns are carried."""
    spark = docs.sparkSession
    rows = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("")).alias("id"), F.coalesce(benchmark[item_text], F.lit("")).alias("words"))
    size = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = rows if blocks == 1 else written(rows.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(blocks))))

    def shared(part: DataFrame):
        got = sorted(zip(*(c.to_pylist() for c in part.select("id", "words").toArrow().columns)))
        return spark.sparkContext.broadcast(([i for i, _ in got], [x for _, x in got]))

    if blocks == 1:
        return docs.withColumn(into, _search(shared(rows), window)(docs[text]))
    digest, parts = F.sha2(docs[text], 256), []
    for k in range(blocks):
        sent = shared(rows.filter(F.col("block") == k))
        hit = docs.select(digest.alias("digest"), _search(sent, window)(docs[text]).alias("f")).filter(F.size("f.spans") > 0)
        parts.append(written(hit.dropDuplicates(["digest"])))
        sent.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    gathered = [F.flatten(F.collect_list(f"f.{n}")).alias(n) for n in ("spans", "items", "matches")]
    mark = fresh(docs, "__digest")
    every = written(every.groupBy(F.col("digest").alias(mark)).agg(*gathered).select(mark, F.struct("spans", "items", "matches").alias("__f")))
    count = fresh(docs, "__count")
    both = docs.withColumn(count, word_count()(docs[text])).withColumn(mark, digest)
    both = both.join(broadcast_if_small(every.withColumnRenamed("__f", found := fresh(docs, "__found"))), mark, "left")
    none = lambda n, kind: F.coalesce(F.col(f"{found}.{n}"), F.array().cast(kind)).alias(n)
    leak = F.struct(F.col(count).alias("n_words"), none("spans", SPANS), F.array_sort(F.array_distinct(none("items", "array<string>"))).alias("items"), none("matches", MATCHES))
    return both.withColumn(into, leak).drop(count, mark, found)


def covered(spans: Column) -> Column:
    """Words inside any span: spans in order of place, each adding what lies past the furthest end so far."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["first"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **named) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated, and the matches themselves.

    Cases are those of ``with_matches``; columns besides the two named are not read."""
    found = with_matches(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), benchmark, window=window, **named)
    items = F.array_sort(F.col("leak.items"))
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        covered(F.col("leak.spans")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("leak.spans") > 0).alias("contaminated"),
        F.col("leak.matches").alias("matches"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **named) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns, whatever their names."""
    mark = fresh(docs, "__leak")
    kept = with_matches(docs, benchmark, text, into=mark, **named).filter(F.size(f"{mark}.spans") == 0)
    return kept.drop(mark)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS k
  FROM b, unnest(range(greatest(len(w) - 9, least(len(w), 1)))) AS t(i)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) AS t(i)),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
hit_words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
