"""Language identification with hyperdimensional profiles.

Each letter, of any script, has a random vector of +1 and -1 of its own. A trigram's vector binds its letters' vectors,
each permuted by its place; a document's vector bundles (adds) its trigrams; a language's prototype bundles the unit
vectors of its documents. A document gets the language of the prototype with the largest cosine.

Profiles are sums, so learning is one pass that sends a vector of fixed length for each language and task, added up by
Spark. What reaches the driver is one vector a language. Sums also let a text of any length be read a piece at a time.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import CHUNK, bucket, held, mix, slices, table

#: A multiple of 64.
DIMENSIONS = 1024
SEED = 11
UNKNOWN = "und"
#: Counts of trigrams in texts that a step holds, and trigrams whose vectors it holds.
COUNTS, HELD = 1 << 21, 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_bits(points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The random vectors of letters (code points), a bit for each sign, as (n, dimensions / 64) words."""
    base = mix(points.astype(np.uint64) * _STEP + np.uint64(seed))
    return mix(base[:, None] + _STEP * np.arange(1, dimensions // 64 + 1, dtype=np.uint64))


class Letters:
    """Numbers of the letters met so far, from 1, and their vectors. A capital has its small letter's."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.number = np.zeros(0x110000, np.int32)
        self.known = np.zeros(0x1100, bool)
        self.place: dict[int, int] = {}
        self.bits = np.zeros((1, dimensions // 64), np.uint64)

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """0 for what isn't a letter."""
        pages = np.flatnonzero(np.bincount(points >> 8, minlength=len(self.known)).astype(bool) & ~self.known)
        for page in pages.tolist():
            self.known[page] = True
            for c in range(page << 8, (page + 1) << 8):
                if chr(c).isalpha():
                    low = ord(chr(c).lower()[0])
                    self.number[c] = self.place.setdefault(low, len(self.place) + 1)
        if len(self.place) + 1 > len(self.bits):
            new = np.array(list(self.place)[len(self.bits) - 1 :], np.uint32)
            self.bits = np.concatenate([self.bits, letter_bits(new, self.dimensions, self.seed)])
        return self.number[points]

    def trigrams(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Bound vectors of +1 and -1: signs multiply, and the place of a letter turns its vector by so many words."""
        bits = np.roll(self.bits[a], 2, axis=1) ^ np.roll(self.bits[b], 1, axis=1) ^ self.bits[c]
        return 1.0 - 2.0 * np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def letters(dimensions: int = DIMENSIONS, seed: int = SEED) -> Letters:
    ready = held("letters")
    if (dimensions, seed) not in ready:
        ready[dimensions, seed] = Letters(dimensions, seed)
    return ready[dimensions, seed]


def _added(out: np.ndarray, s: np.ndarray, doc: np.ndarray, vectors: Letters) -> None:
    """Adds the trigrams of symbols ``s`` (0: no letter) to the rows ``doc`` of ``out``; a trigram belongs to its middle, a letter."""
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)  # what isn't a letter counts once in a row
    s, doc = s[keep], doc[keep]
    there = np.flatnonzero(np.bincount(s))
    u = len(there)
    local = np.zeros(int(there[-1]) + 1, np.int32 if u < 1290 else np.int64)  # a trigram's code is below u ** 3
    local[there] = np.arange(u)
    x, middle = local[s], s[1:-1] > 0
    codes, doc = ((x[:-2] * u + x[1:-1]) * u + x[2:])[middle], doc[1:-1][middle]
    n = len(out)
    step = max(1, min(n, COUNTS // HELD))
    at = np.searchsorted(doc, np.arange(0, n + step, step))
    for i, lo in enumerate(range(0, n, step)):
        d, c = doc[at[i] : at[i + 1]] - lo, codes[at[i] : at[i + 1]]
        if not len(c):
            continue
        if u**3 <= 1 << 20:
            used = np.flatnonzero(np.bincount(c, minlength=u**3))
            place = np.zeros(u**3, np.int32)
            place[used] = np.arange(len(used))
            c = place[c]
        else:
            used, c = np.unique(c, return_inverse=True)
        m = min(step, n - lo)
        wide = m * len(used) > 4 * COUNTS
        if wide:
            order = np.argsort(c, kind="stable")
            d, c = d[order], c[order]
            cuts = np.searchsorted(c, np.arange(0, len(used) + HELD, HELD))
        else:
            every = np.bincount(d * len(used) + c, minlength=m * len(used)).reshape(m, len(used))
        for j, first in enumerate(range(0, len(used), HELD)):
            g = used[first : first + HELD]
            if wide:
                own = slice(cuts[j], cuts[j + 1])
                counts = np.bincount(d[own] * len(g) + c[own] - first, minlength=m * len(g)).reshape(m, len(g))
            else:
                counts = every[:, first : first + HELD]
            out[lo : lo + m] += counts.astype(np.float32) @ vectors.trigrams(there[g // (u * u)], there[g // u % u], there[g % u])


def bundles(texts: pa.Array, dimensions: int = DIMENSIONS, seed: int = SEED):
    """For a bounded run of texts at a time: their vectors (float32), and whether they have a letter. A long text is read in pieces."""
    vectors = letters(dimensions, seed)
    for part in slices(texts, CHUNK):
        rows = part.to_pylist()
        joined = "\0".join(["", *rows, ""])  # every text stands between two marks, which aren't letters
        sizes = np.array([len(x) + 1 for x in rows])
        ends = np.cumsum(sizes)
        out, some = np.zeros((len(rows), dimensions), np.float32), np.zeros(len(rows), bool)
        for lo in range(1, len(joined) - 1, CHUNK):
            hi = min(lo + CHUNK, len(joined) - 1)
            points = np.frombuffer(joined[lo - 1 : hi + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            s = vectors.numbers(points)
            q = max(lo - 2, 0)  # a text and the mark after it are its places, from 0
            first = int(np.searchsorted(ends, q, "right"))
            shares = np.minimum(ends[first:], hi) - np.clip(ends[first:] - sizes[first:], q, hi)
            doc = np.repeat(np.arange(first, len(rows), dtype=np.int32), np.maximum(shares, 0))
            doc = np.concatenate([doc[:1], doc]) if lo == 1 else doc
            some[doc[1:-1][s[1:-1] > 0]] = True
            _added(out, s, doc, vectors)
        yield out, some


def prototypes(docs: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes (unit vectors), learned from the rows whose language isn't null."""

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            named, lo = np.array(batch.column(1).to_pylist(), object), 0
            for out, some in bundles(batch.column(0), dimensions, seed):
                out = out[some] / np.maximum(np.linalg.norm(out[some], axis=1, keepdims=True), 1e-9)
                who = named[lo : lo + len(some)][some]
                lo += len(some)
                for name in set(who.tolist()):
                    sums[name] = sums.get(name, 0) + out[who == name].sum(0, dtype=np.float64)
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(x)], ["lang", "place", "value"])

    learned = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    sums = learned.mapInArrow(bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in rows]
    found = np.array([[x["value"] for x in r["v"]] for r in rows], np.float32).reshape(len(rows), dimensions)
    return names, found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def identify(model: tuple[list[str], np.ndarray], spark, seed: int = SEED):
    """A column function: struct of lang_pred, score (the cosine, not below 0) and lettered (whether the text has a letter)."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double,lettered:boolean>")
    def score(texts: pa.Array) -> pa.Array:
        names, found = shared.value
        who, how, lettered = [], [], []
        for out, some in bundles(texts, found.shape[1], seed):
            lettered += some.tolist()
            if not len(names):
                who += [UNKNOWN] * len(some)
                how += [0.0] * len(some)
                continue
            cosine = out @ found.T / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
            best = cosine.argmax(1)
            who += [names[b] if s else UNKNOWN for b, s in zip(best, some)]
            how += np.where(some, np.clip(cosine.max(1), 0.0, 1.0), 0.0).astype(float).tolist()
        return pa.StructArray.from_arrays([pa.array(who, pa.string()), pa.array(how, pa.float64()), pa.array(lettered, pa.bool_())], ["lang_pred", "score", "lettered"])

    return score


def with_language(docs: DataFrame, learn_from: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", into: str = "language", parts: int = 4, held_out: int = 2, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with a struct column ``into`` (lang_pred, score, lettered). Rows of ``learn_from`` in the held-out part teach nothing.

    A text that is null, empty or has no letter is ``und`` with score 0, as is every text if nothing was learned (an
    empty table, or no languages); ``lettered`` tells the two apart. Equal cosines (ties) go to the first name. A very
    long text is read whole, in pieces. Repeated rows get equal answers; a column named ``into`` is replaced, other
    columns are carried as they are; an empty table stays empty."""
    known = learn_from.filter(bucket(learn_from[doc_id], parts) != held_out)
    model = prototypes(known, text, lang, dimensions)
    return docs.withColumn(into, identify(model, docs.sparkSession)(docs[text]))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = with_language(docs, docs)
    return got.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "language.lang_pred", "language.score")
