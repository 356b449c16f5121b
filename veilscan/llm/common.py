"""Helpers that the training-data operators share: words, shingles, hashes, what a worker remembers."""

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import broadcast_if_small, removed, shared_dir, written  # noqa: F401  (operators take them from here)

#: Lower-case A-Z only; a word is a run of digits, a-z and anything outside ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of text whose words are hashed at a time: bounds the arrays that stand beside a text, however long it is.
CHUNK = 1 << 20
#: Bytes of texts that an operator works on together.
RUN = 1 << 19

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IS_WORD[_lo : _hi + 1] = False
_IS_WORD[65:91] = True  # capitals count as the small letters they become

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOW_BYTE = BYTE[_LOW]
_POWERS: dict[str, np.ndarray] = {}
_HELD: dict[str, tuple] = {}
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def held(owner: str) -> dict:
    """What a worker keeps for one operator between batches. What other operators kept in earlier tasks goes, so that the stages of a job don't add up."""
    context = TaskContext.get()
    now = context.taskAttemptId() if context else None
    others = [name for name, (task, _) in _HELD.items() if name != owner and task != now]
    for name in others:
        del _HELD[name]
    if others:
        gc.collect()
        release()
    kept = _HELD[owner][1] if owner in _HELD else {}
    _HELD[owner] = (now, kept)
    return kept


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20):
    """Arrow batches of bounded rows and bytes for what is written inside, unless the session says otherwise; then as before.

    Queries of other threads of the session get such batches meanwhile too; no result depends on them."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    own = [key for key in wanted if spark.conf.get(key, None) is None]
    for key in own:
        spark.conf.set(key, wanted[key])
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2**64; those for one chunk are kept."""
    if n > CHUNK or name not in _POWERS:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        made = np.multiply.accumulate(steps)
        if n > CHUNK:
            return made[:n]
        _POWERS[name] = made
    return _POWERS[name][:n]


def slices(texts: pa.Array, most_bytes: int = RUN):
    """Runs of rows of at most ``most_bytes`` of text (a longer text is a run of its own), as large_string arrays without nulls."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    ends = text_ends(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most_bytes, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi
    release()


def release() -> None:
    """Hands memory that the last run of texts has left free back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_ends(texts: pa.Array) -> np.ndarray:
    """Offsets into the bytes of a large_string array, one more than texts."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a large_string array, and each text's offsets (one more than texts)."""
    ends = text_ends(texts)
    first, last = int(ends[0]), int(ends[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, ends - first


def hashed(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in order of place: byte values times powers of the place in the span, taken for a chunk at once from running sums."""
    out, i = np.zeros(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(stop, begin[i] + CHUNK, "right")))
        lo, hi = int(begin[i]), int(stop[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * _powers("p", _P, hi - lo), out=sums[1:])
        a, b = begin[i:j] - lo, stop[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _powers("q", _P_INV, hi - lo)[a]
        i = j
    return mix(out)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a large_string array, and the words of each text: offsets into the hashes (one more than texts)."""
    hashes, at, _ = word_spans(texts)
    return hashes, at


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``words``, with the bytes of all texts (capitals as they are) and each word's first byte and the byte past its last."""
    data, ends = text_bytes(texts)
    inside = _IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    begin[cuts] = inside[cuts]
    begin = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cuts = ends[1:][ends[1:] > 0] - 1
    stop[cuts] = inside[cuts]
    del inside
    stop = np.flatnonzero(stop) + 1
    return hashed(data, begin, stop, LOW_BYTE), np.searchsorted(begin, ends), (data, begin, stop)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOW[data]


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``width`` words of each text, with the text's number; a text of fewer words, but not none, is one shingle."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - np.repeat(at[:-1], n)
    long = n >= width
    keep = (place + width <= n[doc]) | (~long[doc] & (place == 0))
    start = np.flatnonzero(keep)
    total = np.zeros(len(start), np.uint64)
    for j in range(width):
        inside = place[start] + j < n[doc[start]]
        total = np.where(inside, mix(total + hashes[np.minimum(start + j, max(len(hashes) - 1, 0))] + np.uint64(j + 1)), total)
    return total, doc[start]


#: Groups that go to every task; more are joined by a shuffle, with each key's rows dealt over so many parts.
BROADCAST, PARTS = 200_000, 32


def with_groups(rows: DataFrame, groups: DataFrame, key: str, by: list[str], most: int = BROADCAST) -> DataFrame:
    """``rows`` with the columns of their group, null where there is none; ``groups`` is a written table with one short row a key.

    Where groups are too many for a broadcast, rows of a very common key are dealt over PARTS tasks by the columns ``by``
    and by the task that read them, so that rows that are alike don't meet either."""
    if groups.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(groups), key, "left")
    part = fresh(rows, fresh(groups, "__part"))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.lit(PARTS)))
    everywhere = groups.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(everywhere, [key, part], "left").drop(part)


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters as they are; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever the case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
