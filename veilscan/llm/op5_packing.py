"""Packing: documents are dealt to windows by a plan over the histogram of their lengths.

A document is its ids and an end id. Whole windows of it stand alone. What is left over (less than a window) has a
length; shallow combinations of at most three different lengths that fill a window exactly are enumerated, and
non-negative least squares gives how often each is wanted, so that the lengths of the plan match the histogram. Rounded
and held to the supply, the plan says for the r-th remainder of a length in which sequence and where it lies. Residuals
are packed greedily, the longest first and then the longest that still fits; where that would leave a window short, the
remainders are cut at powers of two instead, which fill windows without a gap, so only the last sequence is padded.

The histogram has one number a length, so planning on the driver doesn't grow with the corpus. Texts are read once and
are never shuffled: a row carries checksums of its possible pieces.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table, written
from .tokens import VOCABULARY, encoded

WINDOW, END_ID = 2048, 1
#: Rows of one length that are numbered together; a length with more rows is split.
GROUP = 512


def measured(docs: DataFrame, doc_id: str, text: str, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, and checksums: of each whole window, of the rest, and of the rest cut at powers of two."""
    end = int(end_id).to_bytes(4, "little")
    kind = "struct<n:bigint,whole:array<bigint>,rest:bigint,cut:array<bigint>>"

    @arrow_udf(kind)
    def measure(texts: pa.Array) -> pa.Array:
        out = []
        for ids, at in encoded(texts, vocabulary):
            view = memoryview(ids.astype("<u4")).cast("B") if len(ids) else memoryview(b"")
            for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
                n = last - first + 1  # the end id is the last

                def crc(lo: int, hi: int) -> int:
                    own = zlib.crc32(view[4 * (first + lo) : 4 * (first + min(hi, n - 1))])
                    return zlib.crc32(end, own) if hi == n else own

                full = n // window
                lo, cut = full * window, []
                for bit in range(window.bit_length() - 2, -1, -1):
                    if (n % window) >> bit & 1:
                        cut.append(crc(lo, lo + (1 << bit)))
                        lo += 1 << bit
                out.append({"n": n, "whole": [crc(k * window, (k + 1) * window) for k in range(full)], "rest": crc(full * window, n) if n % window else 0, "cut": cut})
        return pa.array(out, pa.struct([("n", pa.int64()), ("whole", pa.list_(pa.int64())), ("rest", pa.int64()), ("cut", pa.list_(pa.int64()))]))

    got = docs.select(docs[doc_id].alias("doc_id"), measure(docs[text]).alias("m"))
    return got.select("doc_id", F.col("m.n").alias("doc_tokens"), (F.col("m.n") % window).cast("int").alias("left"), F.col("m.whole").alias("whole"), F.col("m.rest").alias("rest"), F.col("m.cut").alias("cut"))


def combinations(supply: np.ndarray, window: int, common: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Shallow combinations that fill the window exactly: lengths (m, 3) and how often each is taken (m, 3; 0: unused).

    k of one length with one, two or three of another; and three different lengths of which one is among the commonest."""
    lengths, takes = [], []
    there = np.flatnonzero(supply[1:]) + 1
    for m in (0, 1, 2, 3):
        for a in there.tolist():
            k = np.arange(1, window // a + 1)
            left = window - k * a
            if m == 0:
                k = k[left == 0]
                b = np.zeros(len(k), int)
            else:
                keep = (left > 0) & (left % m == 0)
                k, b = k[keep], left[keep] // m
                keep = (supply[b] > 0) & (b != a)
                k, b = k[keep], b[keep]
            lengths.append(np.stack([np.full(len(k), a), b, np.zeros(len(k), int)], 1))
            takes.append(np.stack([k, np.full(len(k), m), np.zeros(len(k), int)], 1))
    for a in there[np.argsort(-supply[there], kind="stable")][:common].tolist():
        b = there
        c = window - a - b
        keep = (c > b) & (b != a) & (c != a)
        b, c = b[keep], c[keep]
        keep = supply[c] > 0
        b, c = b[keep], c[keep]
        lengths.append(np.stack([np.full(len(b), a), b, c], 1))
        takes.append(np.ones((len(b), 3), int))
    return np.concatenate(lengths), np.concatenate(takes)


def least_squares(lengths: np.ndarray, takes: np.ndarray, supply: np.ndarray, rounds: int = 400, gain: float = 1e-4) -> tuple[np.ndarray, float]:
    """x >= 0 with least ||A x - supply||, and that norm over ||supply||; A[l, j] is how often combination j takes length l.

    Multiplicative steps keep signs and never make the norm larger; they end when ten of them gain less than ``gain`` of ||supply||."""
    want = supply.astype(float)
    want[0] = 0.0
    norm = max(float(np.linalg.norm(want)), 1e-12)
    to = (takes * want[lengths]).sum(1)
    x = np.where(to > 0, 1.0, 0.0) * max(want.sum() / max(takes.sum(), 1), 1e-9)
    flat, last = lengths.ravel(), np.inf
    for i in range(rounds + 1):
        made = np.bincount(flat, (takes * x[:, None]).ravel(), len(want))
        made[0] = 0.0
        residual = float(np.linalg.norm(made - want)) / norm
        if i % 10 == 0:
            if last - residual < gain or i == rounds:
                break
            last = residual
        x = x * (to / np.maximum((takes * made[lengths]).sum(1), 1e-12))
    return x, residual


def greedy(left: np.ndarray, window: int):
    """Patterns {length: how often} that greedy packing, the longest first, finds to fill a window; takes what they use from ``left``. Each comes with its number of windows."""
    for a in range(window - 1, 0, -1):
        while left[a]:
            pattern, room = {a: 1}, window - a
            b = room
            while room and b:
                b = min(b, room)
                there = np.flatnonzero(left[1 : b + 1])
                if not len(there):
                    break
                b = int(there[-1]) + 1
                k = min(room // b, int(left[b]) - pattern.get(b, 0))
                if k > 0:
                    pattern[b] = pattern.get(b, 0) + k
                    room -= k * b
                b -= 1
            if room:
                break  # this length would leave the window short
            n = min(int(left[c]) // k for c, k in pattern.items())
            for c, k in pattern.items():
                left[c] -= n * k
            yield pattern, n


def plan(supply: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Rows (length, first rank, past the last rank, first sequence, place, taken by a sequence), sorted by length and rank; and what is left of each length."""
    left = supply.astype(np.int64).copy()
    left[0] = 0
    rows, sequence, used, residual = [], 0, np.zeros(len(left), np.int64), 0.0

    def take(pairs: list[tuple[int, int]], n: int) -> None:
        nonlocal sequence
        place = 0
        for a, k in pairs:
            rows.append((a, used[a], used[a] + n * k, sequence, place, k))
            used[a] += n * k
            place += a * k
        sequence += n

    if left.any():
        lengths, takes = combinations(left, window)
        x, residual = least_squares(lengths, takes, left)
        order = np.argsort(-x, kind="stable")
        often, wanted = left.tolist(), np.floor(x[order] + 0.5).astype(np.int64).tolist()
        every = [[(a, k) for a, k in zip(c, t) if k] for c, t in zip(lengths[order].tolist(), takes[order].tolist())]
        for bounded in (True, False):  # as rounded; then what combinations can still take
            for pairs, most in zip(every, wanted):
                n = min([often[a] // k for a, k in pairs] + [most] * bounded)
                if n > 0:
                    take(pairs, n)
                    for a, k in pairs:
                        often[a] -= n * k
        left = np.array(often, np.int64)
        for pattern, n in greedy(left, window):
            take(list(pattern.items()), n)
    rows = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return {"rows": rows, "left": left, "used": used, "sequences": np.int64(sequence), "residual": residual}


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text's document is the end id alone; a very long text is windows of its own and a rest. A null or
    repeated doc_id is carried as it is: each row is packed once. Rows of equal length (ties) are ranked by doc_id and
    checksum. Other columns are not read, whatever their names. An empty table gives no pieces. ``window`` is a power of two."""
    if window & (window - 1) or window < 2:
        raise ValueError("the window must be a power of two")
    rows = written(measured(docs, doc_id, text, vocabulary, window, end_id))
    counts = rows.groupBy("left").agg(F.count("*").alias("n"), F.max(F.size("whole")).alias("most")).collect()  # a row for each length below the window
    supply, widest = np.zeros(window, np.int64), 1
    for r in counts:
        supply[r["left"]] = r["n"]
        widest = max(widest, r["most"])
    made = plan(supply, window)

    salts = np.maximum(1, -(-supply // GROUP))
    salt = F.pmod(F.xxhash64("doc_id", "rest", "doc_tokens"), F.element_at(F.array(*[F.lit(int(x)) for x in salts]) if len(set(salts.tolist())) > 1 else F.array_repeat(F.lit(int(salts[0])), window), F.col("left") + 1))
    rows = rows.withColumn("salt", salt)
    own = Window.partitionBy("left", "salt").orderBy("doc_id", "rest", "doc_tokens")
    before = rows.groupBy("left", "salt").agg(F.count("*").alias("n"))
    before = before.select("left", "salt", (F.sum("n").over(Window.partitionBy("left").orderBy("salt")) - F.col("n")).alias("before"))
    rows = rows.withColumn("rank", F.row_number().over(own) - 1).join(before, ["left", "salt"])

    bits = [b for b in range(window.bit_length() - 2, -1, -1)]
    length = np.arange(window)
    tables = {"window": window, "rows": made["rows"], "used": made["used"], "residue": int(made["sequences"]), "bits": bits, "first": {}, "base": {}}
    position = 0
    for b in bits:  # the place of the first piece of each size, and the number of each length's first piece among those of the size
        n = np.where(length >> b & 1, made["left"], 0)
        tables["first"][b] = np.cumsum(n) - n
        tables["base"][b] = position
        position += int(n.sum()) << b
    alone = int(made["sequences"]) + -(-position // window)
    firsts = np.cumsum(supply) - supply
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    @arrow_udf("array<struct<sequence_id:bigint,offset:bigint,length:bigint>>")
    def place(left: pa.Array, rank: pa.Array) -> pa.Array:
        t = shared.value
        left, rank = left.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        r, sizes = t["rows"], np.zeros(len(left), np.int64)
        number, sequence, offset, size = [], [], [], []
        taken = (rank < t["used"][left]) & (left > 0)
        if taken.any():
            i = np.flatnonzero(taken)
            # ranks and lengths as one sorted number
            scale = int(max(r[:, 2].max(), 1)) + 1
            at = np.searchsorted(r[:, 0] * scale + r[:, 1], left[i] * scale + rank[i], "right") - 1
            inside = rank[i] - r[at, 1]
            number.append(i)
            sequence.append(r[at, 3] + inside // r[at, 5])
            offset.append(r[at, 4] + inside % r[at, 5] * left[i])
            size.append(left[i])
        for b in t["bits"]:
            i = np.flatnonzero(~taken & (left >> b & 1).astype(bool))
            where = t["base"][b] + ((t["first"][b][left[i]] + rank[i] - t["used"][left[i]]) << b)
            number.append(i)
            sequence.append(t["residue"] + where // t["window"])
            offset.append(where % t["window"])
            size.append(np.full(len(i), 1 << b))
        number = np.concatenate(number)
        order = np.argsort(number, kind="stable")
        sizes = np.bincount(number, minlength=len(left))
        got = [pa.array(np.concatenate(x)[order].astype(np.int64)) for x in (sequence, offset, size)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(got, ["sequence_id", "offset", "length"]))

    rank = F.col("before") + F.col("rank")
    number = F.element_at(F.lit(firsts.tolist()), F.col("left") + 1) + rank
    whole = F.transform("whole", lambda c, k: F.struct((k.cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), c.alias("ids_crc32"), (F.lit(alone) + F.col("number") * widest + k).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    before_piece = lambda k: F.aggregate(F.slice("placed", F.lit(1), k), F.lit(0).cast("long"), lambda a, p: a + p["length"])
    rest = F.transform("placed", lambda p, k: F.struct((F.size("whole").cast("long") * window + before_piece(k)).alias("start"), p["length"].alias("length"), F.when(p["length"] == F.col("left"), F.col("rest")).otherwise(F.element_at("cut", k + 1)).alias("ids_crc32"), p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset")))
    out = rows.withColumn("number", number).withColumn("placed", place(F.col("left"), rank)).select("doc_id", "doc_tokens", F.explode(F.concat(whole, rest)).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
