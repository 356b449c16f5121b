"""Token ids of a public byte-level BPE vocabulary, by distinct parts of text.

The tokenizer never joins what stands on the two sides of a space between characters that aren't white space, with the
space itself going to the right. So texts are cut before such spaces; of a run of texts each distinct part is encoded
once, and the ids of its texts are put together from those of their parts. Distinct parts go, joined, to a second
encoder of the same vocabulary, whose answer is cut by the parts' bytes; it gives the same ids (a test compares them).
Parts outside the Latin blocks go to the tokenizer itself, as do texts that hold a string of a special token.

Parts are told apart by hash and then compared as bytes. Nothing is kept from run to run but the encoders, and what
stands beside a run of texts is bounded by its bytes: a text that is longer than a run is a run of its own.
"""

import base64
import json
import re
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa

from .common import BYTE, CHUNK, hashed, held, slices, text_bytes

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of texts whose parts are told apart together.
RUN = 2 << 20
#: Letters whose classes have never changed between Unicode versions.
PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*").fullmatch

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Encoder:
    """``run`` gives the ids of texts as one array, and each text's offsets."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path) as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        with open(path.rsplit(".", 1)[0] + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.joint = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(x) for x in ranks]

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, which takes much memory: loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that nothing is known of: plain ones by the joint encoder, others by the tokenizer."""
        out = []
        for x in texts:
            plain = PLAIN(x) and not any(s in x for s in self.special)
            ids = self.joint.encode_to_numpy(x) if plain else self.tokenizer.encode(x, add_special_tokens=False).ids
            out.append(np.asarray(ids, np.uint32))
        return out

    def parts(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts, and where each one's ids begin and how many they are."""
        joins = (data[begin] == 32) & (stop - begin > 1) & ~special
        joins[joins] = ~_BLANK[data[begin[joins] + 1]]
        joined = _gathered(data, begin[joins], stop[joins]).tobytes().decode()  # each begins with a space and a character, so they may stand in a row
        if not PLAIN(joined):
            i = np.flatnonzero(joins)
            joins[i] = [bool(PLAIN(data[a:b].tobytes().decode())) for a, b in zip(begin[i], stop[i])]
            joined = _gathered(data, begin[joins], stop[joins]).tobytes().decode()
        ids = np.asarray(self.joint.encode_to_numpy(joined), np.uint32)
        rest = self.whole([data[a:b].tobytes().decode() for a, b in zip(begin[~joins], stop[~joins])])
        start, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum((stop - begin)[joins])) + 1
        n[joins] = np.diff(cuts, prepend=0)
        start[joins] = cuts - n[joins]
        n[~joins] = [len(x) for x in rest]
        start[~joins] = len(ids) + np.cumsum(n[~joins]) - n[~joins]
        return np.concatenate([ids, *rest]), start, n

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = text_bytes(texts)
        special = np.zeros(len(texts), bool)
        whole = data.tobytes()
        if any(s.encode() in whole for s in self.special):
            special = np.array([any(s in x for s in self.special) for x in texts.to_pylist()], bool)
        begin, stop, of = _cut(data, ends, special)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first, which = _distinct(data, begin, stop)
        ids, start, n = self.parts(data, begin[first], stop[first], special[of[first]])
        n = n[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(start[which] - upto[:-1], n) + np.arange(upto[-1])
        return ids[place], upto[np.searchsorted(of, np.arange(len(texts) + 1))]


def _cut(data: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte past the last, and text of each part; ``whole`` texts aren't cut."""
    spaces = np.flatnonzero(data[1:-1] == 32) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    before, after = data[spaces - 1], data[spaces + 1]
    spaces = spaces[~_BLANK[before] & ~_BLANK[after] & ((before < 128) | (after < 128))]
    heads = ends[:-1][np.diff(ends) > 0]
    inner = np.searchsorted(ends, spaces, "right") - 1  # a space at an end of a text has its neighbours in other texts
    spaces = spaces[(spaces > ends[inner]) & (spaces + 1 < ends[inner + 1]) & ~whole[inner]]
    begin = np.sort(np.concatenate([heads, spaces]))
    return begin, np.append(begin[1:], len(data)), np.searchsorted(ends, begin, "right") - 1


def _gathered(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = stop - begin
    ends = np.cumsum(n)
    return data[np.repeat(begin - ends + n, n) + np.arange(ends[-1])] if len(n) else data[:0]


def _distinct(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of part, and each part's kind."""
    hashes = hashed(data, begin, stop, BYTE)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size, model = stop - begin, first[which]
    same = size == size[model]
    for lo in range(0, len(data), CHUNK):  # as bytes, a chunk at a time
        hi = min(lo + CHUNK, len(data))
        i = slice(int(np.searchsorted(stop, lo, "right")), int(np.searchsorted(begin, hi, "left")))
        a, b = np.maximum(begin[i], lo), np.minimum(stop[i], hi)
        shift = np.repeat(np.where(same[i], begin[model[i]] - begin[i], 0), b - a)
        differ = np.flatnonzero(data[lo + np.arange(hi - lo) + shift] != data[lo:hi])
        same[np.searchsorted(begin, lo + differ, "right") - 1] = False
    if not same.all():  # equal hashes of different parts: these stand for themselves
        other = np.flatnonzero(~same)
        which[other] = len(first) + np.arange(len(other))
        first = np.concatenate([first, other])
    return first, which


def encoder(vocabulary: str) -> Encoder:
    """One per worker and vocabulary, while it is in use."""
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    ready = held("tokens")
    if path not in ready:
        ready[path] = Encoder(path)
    return ready[path]


def encoded(texts: pa.Array, vocabulary: str):
    """(ids, offsets) of a bounded run of texts at a time."""
    ready = encoder(vocabulary)
    for part in slices(texts, RUN):
        yield ready.run(part)
