"""Byte-level BPE encoding and decoding as reductions of trees.

Two monoids do the work. *Texts*: a text is halved until its pieces are small (a text
of one piece is a tree of one leaf). What is known of a piece without its
neighbours is its ids between two sure cuts, and the bytes before the first and after the last. A cut is sure between a
character that isn't white space and one that is: the pattern has no match across it, looks back nowhere, and looks
ahead only inside white space. Neighbours are joined by encoding what lies between the last sure cut of the left one and
the first of the right one; where a piece has no sure cut, that window grows with the pieces up the tree.

*Matches*: a long match of the pattern is halved until its pieces are short enough to merge pair by pair. Neighbours are
joined by encoding a window of the tokens around the seam anew. Tokens outside it stay as they are once those at its two
borders fit their new neighbours, that is, once both together encode to just these two; till then the window grows. Why
this proves the whole: where merges go in order of rank (``in_order`` checks a vocabulary), the first merge across a
border between two tokens would happen with the two alone as well, for until then each has merged as it does alone.

Decoding joins the bytes of halves.
"""

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import held, slices, table, text_bytes
from .tokens import _distinct, _gathered

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a text's smallest pieces, of a match that is merged whole, of texts worked on together; matches merged together.
PIECE, MATCH, RUN, ROWS = 1 << 14, 48, 1 << 20, 1 << 14
NONE = 1 << 30

#: Classes of characters: other, letter, number, white space.
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: those of the public pattern


def _path(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the library that the pattern is written for tells them: it is asked for all letters, numbers and white space."""
    import tiktoken

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bytes_alone = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        ask = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=bytes_alone, special_tokens={})
        out[[ord(c) for c in bytes(ask.encode_ordinary(every)).decode()]] = kind
    return out


def in_order(ranks: dict[bytes, int]) -> bool:
    """Whether merges always go in order of rank, and every token encodes to itself: alone, each token merges to itself
    through lower ranks than its own. Then no merge can make way for one of a lower rank (that one's token would, alone,
    have merged through a higher rank than its own)."""
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best > rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


@lru_cache(maxsize=2)
def _proven(path: str) -> str:
    if not in_order(ranks_of(path)):
        raise ValueError(f"{path}: merges don't go in order of rank, so windows don't prove what lies outside them")
    return path


class Codec:
    def __init__(self, ranks: dict[bytes, int], kinds: np.ndarray):
        self.ranks, self.kinds = ranks, kinds
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.width = np.array([len(x) for x in self.pieces])
        self.start = np.cumsum(self.width) - self.width
        self.blob = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)])
        split = [(ranks[t[:i]] * len(self.pieces) + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs, self.together = np.array(sorted(split), np.int64).reshape(-1, 2).T.copy()
        self.fits = lru_cache(maxsize=1 << 16)(self._fits)

    def merged(self, data: bytes) -> list[int]:
        """By definition: of all neighbours that together are a token, those of the lowest rank are merged, the leftmost first."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < NONE:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        return [ranks[x] for x in parts]

    def _fits(self, left: int, right: int) -> bool:
        return self.merged(self.pieces[left] + self.pieces[right]) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring pieces of a match, from their own."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            inner = self.merged(b"".join([self.pieces[x] for x in left[len(left) - a :]] + [self.pieces[x] for x in right[:b]]))
            on_left = a == len(left) or self.fits(left[-a - 1], inner[0])
            on_right = b == len(right) or self.fits(inner[-1], right[b])
            if on_left and on_right:
                return left[: len(left) - a] + inner + right[b:]
            a, b = a + (not on_left) * a, b + (not on_right) * b

    def match(self, data: bytes) -> list[int]:
        """The ids of one long match of the pattern: a tree of neighbours, level by level."""
        level = [self.merged(data[i : i + MATCH]) for i in range(0, len(data), MATCH)]
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of neighbouring tokens together; NONE where they are no token."""
        pair = left * len(self.pieces) + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.together[at], NONE)

    def all_merged(self, data: np.ndarray, begin: np.ndarray, size: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merged`` of many spans of at most ``size`` bytes at once: their ids in a row, and how many each has."""
        rows, place = np.arange(len(begin)), np.arange(size)
        there = place < n[:, None]
        token = np.where(there, self.of_byte[data[np.minimum(begin[:, None] + place, len(data) - 1)]], -1)
        after, before = np.tile(place + 1, (len(rows), 1)), np.tile(place - 1, (len(rows), 1))
        rank = np.full((len(rows), size), NONE)
        pair = there[:, 1:]
        rank[:, :-1][pair] = self._rank(token[:, :-1][pair], token[:, 1:][pair])
        while len(rows):
            i = rank[rows].argmin(axis=1)
            best = rank[rows, i]
            rows, i, best = rows[best < NONE], i[best < NONE], best[best < NONE]
            j = after[rows, i]
            k = after[rows, j]
            token[rows, i], token[rows, j], rank[rows, j], after[rows, i] = best, -1, NONE, k
            rank[rows, i] = NONE
            h = k < n[rows]
            before[rows[h], k[h]] = i[h]
            rank[rows[h], i[h]] = self._rank(best[h], token[rows[h], k[h]])
            p = before[rows, i]
            h = p >= 0
            rank[rows[h], p[h]] = self._rank(token[rows[h], p[h]], best[h])
        return token[token >= 0], (token >= 0).sum(axis=1)

    def matches(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many matches, where each one's begin among them, and how many they are: short ones together by size, long ones as trees."""
        start, n, out, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), [], 0
        size, least = stop - begin, 0
        for most in (4, 8, 16, MATCH):
            mine = np.flatnonzero((size > least) & (size <= most))
            least = max(least, most)
            for lo in range(0, len(mine), ROWS):
                rows = mine[lo : lo + ROWS]
                ids, n[rows] = self.all_merged(data, begin[rows], most, size[rows])
                start[rows] = total + np.cumsum(n[rows]) - n[rows]
                out.append(ids)
                total += len(ids)
        for row in np.flatnonzero(size > least).tolist():
            ids = self.match(data[begin[row] : stop[row]].tobytes())
            start[row], n[row] = total, len(ids)
            out.append(np.array(ids, np.int64))
            total += len(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int64), start, n

    def starts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts in one array of bytes: the first byte of each match, and the sure cuts, both in order of place. Texts' ends are cuts."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        b0 = data[lead].astype(np.int32)
        code = b0
        if len(lead) < len(data):
            after = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
            b1, b2, b3 = (after[lead + k] & 0x3F for k in (1, 2, 3))
            code = np.select([b0 < 0x80, b0 < 0xE0, b0 < 0xF0], [b0, (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2], (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3)
        kind = self.kinds[code]
        n = len(lead)
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[np.searchsorted(lead, ends)] = True
        new = np.ones(n, bool)  # a run of one class begins here
        new[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
        space = kind == _SPACE
        last_space = space.copy()  # the last of white space before something else of the same text
        last_space[:-1] &= ~space[1:]
        last_space &= ~edge[1:]
        begin = new.copy()
        begin |= last_space
        taken = np.zeros(n, bool)  # a run that the space before it belongs to
        taken[1:] = (last_space & (code == 32))[:-1]
        begin &= ~taken
        # a contraction is taken where a match begins with an apostrophe and letters follow; the rest of the letters is a match of its own
        i = np.flatnonzero(begin & (code == 39))
        if len(i):
            at = lambda k: np.where(i + k < n, code[np.minimum(i + k, n - 1)], -1)
            open_at = lambda k: (i + k < n) & ~edge[np.minimum(i + k, n)]  # noqa: E731  (still in this text)
            size = np.zeros(len(i), np.int64)
            for x in _CONTRACTIONS:
                hit = size == 0
                for k, c in enumerate(x, 1):
                    hit &= open_at(k) & (at(k) == ord(c))
                size[hit] = len(x)
            for k in (1, 2):
                hit = i[size >= k]
                begin[hit + k] = False
            hit = i[size > 0] + size[size > 0] + 1
            begin[hit[hit < n]] = True
        sure = edge[:-1].copy()
        sure[1:] |= space[1:] & ~space[:-1]
        return lead[begin], lead[sure]

    def closed(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that nothing goes before or after, and each one's offsets: each distinct match is encoded once."""
        begin, _ = self.starts(data, ends)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        stop = np.append(begin[1:], len(data))
        first, which = _distinct(data, begin, stop)
        flat, start, n = self.matches(data, begin[first], stop[first])
        upto = np.concatenate([[0], np.cumsum(n[which])])
        out = flat.astype(np.int32)[np.repeat(start[which] - upto[:-1], n[which]) + np.arange(upto[-1])]
        return out, upto[np.searchsorted(begin, ends)]

    def piece(self, data: np.ndarray) -> tuple:
        """What is known of a part of a text: (bytes before its first sure cut, ids, bytes after its last); ids are null without two cuts."""
        sure = self.starts(data, np.array([0, len(data)]))[1]
        sure = sure[sure > 0]  # its own first byte is no cut yet
        if len(sure) == 0:
            return data, None, data[:0]
        inner = data[sure[0] : sure[-1]]
        return data[: sure[0]], self.closed(inner, np.array([0, len(inner)]))[0], data[sure[-1] :]

    def added(self, left: tuple, right: tuple) -> tuple:
        """The monoid's product of two neighbours. A cut may lie on the seam itself: then the bytes on its two sides say so."""
        window = np.concatenate([left[2] if left[1] is not None else left[0], right[0]])
        if left[1] is None and right[1] is None:
            return self.piece(window)
        if left[1] is None:
            before, ids, after = self.piece(window)
            return (window, right[1], right[2]) if ids is None else (before, np.concatenate([ids, self.closed(after, np.array([0, len(after)]))[0], right[1]]), right[2])
        if right[1] is None:
            before, ids, after = self.piece(window)
            if ids is None:
                return left[0], left[1], window
            return left[0], np.concatenate([left[1], self.closed(before, np.array([0, len(before)]))[0], ids]), after
        return left[0], np.concatenate([left[1], self.closed(window, np.array([0, len(window)]))[0], right[1]]), right[2]

    def long(self, data: np.ndarray) -> np.ndarray:
        """The ids of a text of any length, from a tree over its pieces."""
        if not len(data):
            return np.zeros(0, np.int32)
        cuts = np.arange(0, len(data), PIECE)
        cuts = np.array([c - int(((data[max(c - 3, 0) : c + 1] & 0xC0) != 0x80)[::-1].argmax()) for c in cuts.tolist()])  # at characters
        level = [self.piece(data[a:b]) for a, b in zip(cuts, [*cuts[1:], len(data)])]
        while len(level) > 1:
            level = [self.added(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        before, ids, after = level[0]
        ends = [self.closed(x, np.array([0, len(x)]))[0] for x in (before, after)]
        return np.concatenate([ends[0], *([] if ids is None else [ids]), ends[1]])

    def encoded(self, texts: pa.Array):
        """Lists of ids, a bounded run of texts at a time."""
        for run in slices(texts, RUN):
            data, ends = text_bytes(run)
            # texts of one piece together, others as trees
            long = np.diff(ends) > PIECE
            short, upto = self.closed(*text_bytes(run.filter(pa.array(~long))))
            trees = [self.long(data[ends[i] : ends[i + 1]]) for i in np.flatnonzero(long)]
            n = np.zeros(len(run), np.int64)
            n[~long], n[long] = np.diff(upto), [len(x) for x in trees]
            ids, of_tree = np.zeros(int(n.sum()), np.int32), np.repeat(long, n)
            ids[~of_tree] = short
            ids[of_tree] = np.concatenate([*trees, short[:0]])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))

    def decoded(self, lists: pa.Array) -> pa.Array:
        """The bytes of lists of ids; an id that the vocabulary lacks is an error."""
        lists = lists.fill_null([]) if lists.null_count else lists
        ids, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces) or (self.width[ids] == 0).any()):
            raise ValueError("an id that the vocabulary doesn't have")
        upto = np.concatenate([[0], np.cumsum(self.width[ids])])
        data = _gathered(self.blob, self.start[ids], self.start[ids] + self.width[ids])
        offsets = upto[np.concatenate([[0], np.cumsum(n)])]
        return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _codec(path: str, kinds) -> Codec:
    ready = held("bpe")
    if path not in ready:
        ready[path] = Codec(ranks_of(path), kinds.value)
    return ready[path]


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``into``: the array<int> of the text's ids, each match of the public pattern encoded separately, without
    special tokens (their strings are ordinary text). Null and empty texts have no ids. Other columns stay as they are."""
    path, kinds = _proven(_path(vocabulary)), docs.sparkSession.sparkContext.broadcast(classes())

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        parts = list(_codec(path, kinds).encoded(texts))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(into, ids(F.coalesce(docs[text], F.lit(""))))


def decode(rows: DataFrame, ids: str = "ids", into: str = "bytes", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with ``into``: the binary that the ids stand for; null and empty lists are empty."""
    path, at = _path(vocabulary), rows.columns.index(ids)
    if into.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"rows have a column {into} already")

    def run(batches):
        kept = held("bpe decoding")
        if path not in kept:
            kept[path] = Codec(ranks_of(path), np.zeros(1, np.uint8))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, kept[path].decoded(part.column(at))], [*part.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(into, BinaryType())]))


def digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas, lower-case hex."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), into="ids").select("doc_id", "ids")
    out = decode(rows, into="bytes")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
