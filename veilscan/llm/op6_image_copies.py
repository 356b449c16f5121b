"""Copies of images by local descriptors.

Corners are found at several scales; each gets an orientation from its patch's centre of mass and a string of binary
tests, rotated to that orientation. Disjoint parts of the string are keys of Hamming tables: descriptors of queries and
images that share a key are compared in full, and vote for the scale, turn and shift that take one image to the other.
Votes that agree in place are a geometric consensus, which cropped, brightened, smaller, turned or partly painted copies keep.

The tables here have no image column, so ``page_image`` draws one from each page: a texture whose cells take their
brightness from the page's words, so equal pages have equal images and edited pages images with local changes.

Equal images are one class and only its representative is described. Queries go to the tasks in blocks of bounded size.
All corners of an image are in one task, so votes are counted there and only matches leave it. With several blocks,
images' corners are written once and read for each.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import slices, table, with_groups, words, written

SIDE, CELLS = 80, 20
SCALES = (1.0, 0.75, 0.5)
#: A corner has the largest response within so many pixels, of at least STRENGTH, and lies MARGIN pixels from the border.
ALONE, STRENGTH, MARGIN = 1, 1.0, 11
PATCH, TURNS = 6, 32
#: Tables and the bits of their keys: descriptors that differ in fewer bits than there are tables always meet, others mostly;
#: a copy needs VOTES of its corners to meet, so few of these losses lose a copy (tests hold matches against all pairs).
TABLES, KEY_BITS = 6, 21
#: Bits of 128 that may differ; pixels over which votes for a shift are one; votes that make a match.
DIFFER, SLACK, VOTES = 20, 6, 7
QUERY_EVERY = 100
#: Query images of a block, and pairs of descriptors that a task compares at once.
BLOCK, PAIRS = 16384, 1 << 19
#: A corner as it is stored: place in full size, level, turn, the tests.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("level", "i1"), ("turn", "i1"), ("d0", "<i8"), ("d1", "<i8")])

_disc = np.stack(np.meshgrid(np.arange(-PATCH, PATCH + 1), np.arange(-PATCH, PATCH + 1)), -1).reshape(-1, 2)
_DISC = _disc[(_disc**2).sum(1) <= PATCH * PATCH]
_ANGLES = np.arange(TURNS) * (2 * np.pi / TURNS)


def _grown(n: int, m: int) -> np.ndarray:
    """The (m, n) matrix that stretches n values to m by linear interpolation."""
    at = np.linspace(0, n - 1, m)
    lo = np.minimum(at.astype(int), n - 2)
    out = np.zeros((m, n), np.float32)
    out[np.arange(m), lo] = 1 - (at - lo)
    out[np.arange(m), lo + 1] += at - lo
    return out


def _shrunk(n: int, m: int) -> np.ndarray:
    """The (m, n) matrix that averages n values to m of equal width."""
    edge = np.arange(m + 1) * (n / m)
    share = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
    return (np.clip(share, 0, None) * (m / n)).astype(np.float32)


def _turn(patches: np.ndarray) -> np.ndarray:
    """The turn of patches (values on the disc): the direction of their centre of mass."""
    angle = np.arctan2(patches @ _DISC[:, 1].astype(np.float32), patches @ _DISC[:, 0].astype(np.float32))
    return np.round(angle / (2 * np.pi / TURNS)).astype(int) % TURNS


def _chosen(many: int = 1024, seed: int = 29) -> np.ndarray:
    """The places that the 128 tests compare, for each turn: (turn, 2, test, x and y).

    Of random tests those are taken one after another that split patches of random textures most evenly and go least with
    the tests taken before, so that keys of their bits are spread over a table."""
    rng = np.random.default_rng(seed)
    tests = np.clip(np.round(rng.normal(0, PATCH / 2, (many, 4))), -PATCH, PATCH)
    tests = tests[(tests[:, :2] != tests[:, 2:]).any(1)]
    turned = lambda x, y, t: np.stack([np.round(np.cos(t) * x - np.sin(t) * y), np.round(np.sin(t) * x + np.cos(t) * y)], -1).astype(np.int64)
    places = np.stack([np.stack([turned(tests[:, i], tests[:, i + 1], t) for i in (0, 2)]) for t in _ANGLES])
    stretch = _grown(24, 96)
    textures = stretch @ rng.integers(0, 256, (40, 24, 24)).astype(np.float32) @ stretch.T
    x = np.stack([sum(textures[:, i : i + 94, j : j + 94] for i in range(3) for j in range(3)) / 9]).reshape(40, 94, 94)
    image, cy, cx = rng.integers(0, 40, 3000), rng.integers(MARGIN, 94 - MARGIN, 3000), rng.integers(MARGIN, 94 - MARGIN, 3000)
    turn = _turn(x[image[:, None], cy[:, None] + _DISC[:, 1], cx[:, None] + _DISC[:, 0]])
    value = [x[image[:, None], cy[:, None] + places[turn, i, :, 1], cx[:, None] + places[turn, i, :, 0]] for i in (0, 1)]
    bits = (value[0] < value[1]).astype(np.float32)
    even = np.abs(bits.mean(0) - 0.5)
    bits = (bits - bits.mean(0)) / np.maximum(bits.std(0), 1e-6)
    taken, worst = [int(np.argmin(even))], np.zeros(len(tests))
    while len(taken) < 128:
        worst = np.maximum(worst, np.abs(bits.T @ bits[:, taken[-1]]) / len(bits))
        worst[taken[-1]] = np.inf
        taken.append(int(np.argmin(worst + 2 * even)))
    return places[:, :, np.array(taken)[np.argsort(np.arange(128) % TABLES, kind="stable")]]  # each key has early and late ones


_TURNED = _chosen()


def drawn(pages: pa.Array):
    """Images of pages, a bounded run at a time: (n, SIDE, SIDE) bytes.

    A cell's brightness comes from the smallest hash among its words; a cell without words is grey, as null and empty pages are."""
    stretch, none = _grown(CELLS, SIDE), np.iinfo(np.uint64).max
    for part in slices(pages, 1 << 19):
        hashes, at = words(part)
        n = len(part)
        cell = np.full((n, CELLS * CELLS), none, np.uint64)
        doc = np.repeat(np.arange(n), np.diff(at))
        np.minimum.at(cell.ravel(), doc * CELLS * CELLS + (hashes % np.uint64(CELLS * CELLS)).astype(np.int64), hashes)
        value = np.where(cell == none, np.uint64(128), (cell >> np.uint64(13)) & np.uint64(255))
        grid = value.astype(np.float32).reshape(n, CELLS, CELLS)
        yield np.clip(stretch @ grid @ stretch.T, 0, 255).astype(np.uint8)


def stored(images: pa.Array):
    """Square images that a column holds as bytes, row by row, in bounded runs of one size."""
    sides = [math.isqrt(len(x.as_buffer())) for x in images]
    lo = 0
    while lo < len(images):
        hi = lo + 1
        while hi < min(len(images), lo + 256) and sides[hi] == sides[lo]:
            hi += 1
        yield np.stack([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, sides[lo]) for x in images.slice(lo, hi - lo)])
        lo = hi


def page_image():
    """A column function: the image of a page, SIDE x SIDE bytes, row by row."""

    @arrow_udf("binary")
    def draw(pages: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for images in drawn(pages) for x in images], pa.binary())

    return draw


def edited(image: np.ndarray) -> np.ndarray:
    """A cropped, dimmed copy with a painted corner; where it is cut depends on the image."""
    h, w = image.shape
    cut = int(image.astype(np.int64).sum())
    top, left = cut % (h // 6 + 1), cut // 7 % (w // 6 + 1)
    out = image[top : top + h * 5 // 6, left : left + w * 5 // 6].astype(np.float32) * 0.85 + 12
    out[: h // 8, : w // 8] = 20
    return out.astype(np.uint8)


def _summed(x: np.ndarray, width: int) -> np.ndarray:
    """Sums over squares of an odd width, where these lie inside."""
    for axis in (1, 2):
        n = x.shape[axis] - width + 1
        parts = [x[:, i : i + n] if axis == 1 else x[:, :, i : i + n] for i in range(width)]
        x = parts[0] + parts[1]
        for p in parts[2:]:
            x += p
    return x


def _peaks(r: np.ndarray, radius: int) -> np.ndarray:
    """The largest value within a radius, where it lies inside."""
    for axis in (1, 2):
        n = r.shape[axis] - 2 * radius
        parts = [r[:, i : i + n] if axis == 1 else r[:, :, i : i + n] for i in range(2 * radius + 1)]
        r = np.maximum(parts[0], parts[1])
        for p in parts[2:]:
            np.maximum(r, p, out=r)
    return r


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For images of one size (n, h, w): the number of corners' images, in order, and the corners (CORNER)."""
    found, numbers = [np.zeros(0, CORNER)], [np.zeros(0, np.int64)]
    n, h, w = images.shape
    for level, scale in enumerate(SCALES):
        a, b = int(h * scale), int(w * scale)
        if min(a, b) <= 2 * MARGIN + 2:
            continue
        x = images.astype(np.float32)
        if scale != 1.0:
            x = _shrunk(h, a) @ x @ _shrunk(w, b).T
        x = _summed(x, 3) / 9  # from pixel 1 on
        gx, gy = (x[:, 1:-1, 2:] - x[:, 1:-1, :-2]) / 2, (x[:, 2:, 1:-1] - x[:, :-2, 1:-1]) / 2  # from 2
        xx, yy, xy = (_summed(g, 5) for g in (gx * gx, gy * gy, gx * gy))  # from 4
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        k = MARGIN - 4 - ALONE
        inner = r[:, MARGIN - 4 : a - MARGIN - 4, MARGIN - 4 : b - MARGIN - 4]
        top = (inner == _peaks(r[:, k : a - 8 - k, k : b - 8 - k], ALONE)) & (inner > STRENGTH)
        image, py, px = np.nonzero(top)
        if not len(image):
            continue
        py, px = py + MARGIN, px + MARGIN
        wide, flat = b - 2, x.ravel()
        base = (image * (a - 2) + py - 1) * wide + px - 1
        turn = _turn(flat[base[:, None] + _DISC[:, 1] * wide + _DISC[:, 0]])
        place = _TURNED[..., 1] * wide + _TURNED[..., 0]
        value = [flat[base[:, None] + place[turn, i]] for i in (0, 1)]
        bits = np.packbits(value[0] < value[1], axis=1).view(np.int64)
        own = np.zeros(len(image), CORNER)
        for name, c in zip(CORNER.names, (px / scale, py / scale, level, turn, bits[:, 0], bits[:, 1])):
            own[name] = c
        found.append(own)
        numbers.append(image)
    number = np.concatenate(numbers)
    order = np.argsort(number, kind="stable")
    return number[order], np.concatenate(found)[order]


def keys(d0: np.ndarray, d1: np.ndarray) -> list[np.ndarray]:
    """The keys of the Hamming tables: disjoint runs of bits."""
    mask = (1 << KEY_BITS) - 1
    return [(d >> s) & mask for d in (d0, d1) for s in range(0, 64 - KEY_BITS + 1, KEY_BITS)]


def corners(images: DataFrame, source=None, edit: bool = False) -> DataFrame:
    """(id, corners): the packed corners of (id, image) rows, by bounded runs of images that ``source`` makes of the column."""
    source = source or stored

    def run(batches):
        for batch in batches:
            lo = 0
            for some in source(batch.column(1)):
                number, found = describe(np.stack([edited(i) for i in some]) if edit else some)
                at = np.searchsorted(number, np.arange(len(some) + 1))
                packed = [found[i:j].tobytes() for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)), pa.array(packed, pa.binary())], ["id", "corners"])
                lo += len(some)

    return images.select(F.col("id").cast("long").alias("id"), "image").mapInArrow(run, "id long, corners binary")


def unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of images and corners, as ``describe`` gives them."""
    parts = [np.frombuffer(x.as_buffer(), CORNER) for x in packed]
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate([np.zeros(0, CORNER), *parts])


class Block:
    """Corners of some queries with the Hamming tables over them: for each key the corners that have it."""

    def __init__(self, ids: np.ndarray, packed: pa.Array):
        order = np.argsort(ids)
        self.ids = ids[order]
        self.query, self.corner = unpacked(packed.take(pa.array(order)))
        n = np.maximum(np.bincount(self.query, minlength=len(ids)), 1)
        self.centre = np.stack([np.bincount(self.query, self.corner[c], len(ids)) / n for c in ("x", "y")], 1)
        self.tables = []
        for key in keys(self.corner["d0"], self.corner["d1"]):
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.tables.append((key[order].astype(np.int32), order))


def _near(block: Block, corner: np.ndarray, tables: list):
    """Pairs (corner, query's corner) that share a key and differ in at most DIFFER bits, each once; ``tables`` has each table's first entry and number of entries for each corner."""
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for t, (lo, n) in enumerate(tables):
        ends = np.cumsum(n)
        for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            at = np.arange(first, min(first + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, at, "right")
            j = block.tables[t][1][lo[i] + at - (ends[i] - n[i])]
            a, b = corner["d0"][i] ^ block.corner["d0"][j], corner["d1"][i] ^ block.corner["d1"][j]
            keep = np.bitwise_count(a.view(np.uint64)) + np.bitwise_count(b.view(np.uint64)) <= DIFFER
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            seen = np.zeros(len(i), bool)  # an earlier table has the pair
            for key in keys(a, b)[:t]:
                seen |= key == 0
            got.append((i[~seen], j[~seen].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*got))


def _votes(group: np.ndarray, place: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups that have VOTES different places or more, and how many they have."""
    both = np.sort(group * places + place)
    own = both[np.diff(both, prepend=-1) > 0] // places
    first = np.flatnonzero(np.diff(own, prepend=-1))
    votes = np.diff(np.append(first, len(own)))
    return own[first][votes >= VOTES], votes[votes >= VOTES]


def _among(group: np.ndarray, good: np.ndarray) -> np.ndarray:
    at = np.searchsorted(good, group)
    return at < len(good) if not len(good) else good[np.minimum(at, len(good) - 1)] == group


def consensus(block: Block, image: np.ndarray, corner: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the corners of images: image number, query number, votes, scale, turn, dx and dy of the places with VOTES votes or more."""
    out = [tuple(np.zeros(0) for _ in range(7))]
    tables, load = [], np.zeros(len(image), np.int64)
    for t, key in enumerate(keys(corner["d0"], corner["d1"])):
        lo, hi = (np.searchsorted(block.tables[t][0], key.astype(np.int32), side) for side in ("left", "right"))
        tables.append((lo, hi - lo))
        load += tables[-1][1]
    # runs of whole images, so that a run's pairs are bounded
    firsts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]]) if len(image) else np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(load)]
    ends, at = np.r_[firsts[1:], len(image)], 0
    ratios, of_ratio = np.unique(np.round([q / m for q in SCALES for m in SCALES], 6), return_inverse=True)
    places = len(block.corner)
    while at < len(firsts):
        to = max(at + 1, int(np.searchsorted(total[ends], total[firsts[at]] + PAIRS, "right")))
        a, b = firsts[at], ends[to - 1]
        at = to
        i, j = _near(block, corner[a:b], [(lo[a:b], n[a:b]) for lo, n in tables])
        i = i + a
        # a corner at level l of a query shows at level m of an image that is scale times as large; most pairs of images
        # share a corner or two by chance: only those with places enough are looked at, first by scale, then by turn too
        ratio = of_ratio[block.corner["level"][j].astype(np.int64) * len(SCALES) + corner["level"][i]]
        pair = ((image[i] - image[a]) * len(block.ids) + block.query[j]) * len(ratios) + ratio
        keep = _among(pair, _votes(pair, j, places)[0])
        i, j, pair = i[keep], j[keep], pair[keep]
        turn = (corner["turn"][i].astype(np.int64) - block.corner["turn"][j]) % TURNS
        i, j, pair = (np.tile(c, 3) for c in (i, j, pair))
        turn = np.concatenate([turn, (turn + 1) % TURNS, (turn - 1) % TURNS])  # a measured turn is off by one at times
        keep = _among(pair * TURNS + turn, _votes(pair * TURNS + turn, j, places)[0])
        i, j, pair, turn = i[keep], j[keep], pair[keep], turn[keep]
        if not len(i):
            continue
        _, pair = np.unique(pair, return_inverse=True)  # few are left: small numbers again
        scale = ratios[of_ratio[block.corner["level"][j].astype(np.int64) * len(SCALES) + corner["level"][i]]]
        # where the query's middle lies in the image: there an error in the turn moves least
        centre = block.centre[block.query[j]]
        qx, qy = block.corner["x"][j] - centre[:, 0], block.corner["y"][j] - centre[:, 1]
        c, s = np.cos(_ANGLES[turn]), np.sin(_ANGLES[turn])
        dx, dy = corner["x"][i] - scale * (c * qx - s * qy), corner["y"][i] - scale * (s * qx + c * qy)
        # two grids, half a cell apart, in each direction: votes that are close share a cell of one of them
        for ox in (0.0, SLACK / 2):
            for oy in (0.0, SLACK / 2):
                u, v = (np.floor((d + o) / SLACK).astype(np.int64) for d, o in ((dx, ox), (dy, oy)))
                wide, high = int(np.ptp(u)) + 1, int(np.ptp(v)) + 1
                cells, cell = np.unique(((pair * TURNS + turn) * wide + u - u.min()) * high + v - v.min(), return_inverse=True)
                good, votes = _votes(cell, j, places)
                n, own = np.bincount(cell), np.zeros(len(cells), np.int64)
                own[cell[::-1]] = np.arange(len(cell))[::-1]  # a cell's first row
                mx, my = (np.bincount(cell, d)[good] / n[good] for d in (dx, dy))
                own = own[good]
                cx, cy = block.centre[block.query[j[own]]].T
                shift = (mx - scale[own] * (c[own] * cx - s[own] * cy), my - scale[own] * (s[own] * cx + c[own] * cy))
                out.append((image[i][own], block.query[j][own], votes, scale[own], turn[own] * (360.0 / TURNS), *shift))
    return tuple(np.concatenate(c) for c in zip(*out))


def copies(images: DataFrame, queries: DataFrame, source=None, edit_queries: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, votes, scale, turn, dx, dy) of images that a query matches: the best consensus, an image's pixel being the query's, turned and scaled, and a shift.

    Queries are asked in turn in blocks of about ``block`` images, whose matches are written before the next. Of consensuses
    of equal votes (ties) the largest scale, then turn, is given. Null images have no corners; equal ids are asked alike."""
    spark = images.sparkSession
    asked = written(corners(queries, source, edit_queries))
    n = -(-asked.count() // block)
    described = written(corners(images, source)) if n > 1 else corners(images, source)
    found = []
    for k in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k).dropDuplicates(["id", "corners"]).toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast(Block(rows["id"].to_numpy(), rows["corners"].combine_chunks()))
        found.append(written(_matches(described, shared)))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], _MATCH)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.max(F.struct("votes", F.round("scale", 3).alias("scale"), F.round("turn", 2).alias("turn"), F.round("dx", 1).alias("dx"), F.round("dy", 1).alias("dy")))
    return every.groupBy("query_id", "id").agg(best.alias("b")).select("query_id", "id", "b.votes", "b.scale", "b.turn", "b.dx", "b.dy")


_MATCH = "query_id long, id long, votes long, scale double, turn double, dx double, dy double"


def _matches(described: DataFrame, shared) -> DataFrame:
    """Places with votes enough between images' corners and a broadcast block's queries, counted inside the tasks."""

    def run(batches):
        for batch in batches:
            image, query, votes, *rest = consensus(shared.value, *unpacked(batch.column(1)))
            cols = [pa.array(shared.value.ids[query.astype(np.int64)], pa.int64()), batch.column(0).take(pa.array(image.astype(np.int64))), pa.array(votes.astype(np.int64)), *[pa.array(c.astype(float)) for c in rest]]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "id", "votes", "scale", "turn", "dx", "dy"])

    return described.mapInArrow(run, _MATCH)


def page_copies(pages: DataFrame, page_id: str = "page_id", html: str = "html", every: int = QUERY_EVERY) -> DataFrame:
    """Membership and matches of page images.

    ``member`` rows name each page's class (the smallest page_id with an equal image source); ``match`` rows are pairs of
    class representatives: an edited copy of class query_id's image, of classes that have a page_id divisible by
    ``every``, was recognised in class page_id's image. Null and empty pages are drawn plain and match nothing; a very long
    page is drawn whole; a row without page_id is a member of its class and no query; repeated rows are repeated members;
    a class with only null ids is no image. Other columns are not read, whatever their names; an empty table gives no rows."""
    rows = pages.select(pages[page_id].alias("page_id"), F.coalesce(pages[html], F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    asks = F.coalesce(F.col("page_id") % every == 0, F.lit(False))
    several = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max(asks).alias("asked"), F.count("*").alias("n")).filter("n > 1").drop("n")
    named = with_groups(rows, written(several), "digest", ["page_id"]).withColumn("class_id", F.coalesce("first_id", "page_id")).withColumn("ask", F.coalesce("asked", asks))
    reps = named.filter("page_id = class_id")
    images = reps.select(F.col("page_id").alias("id"), F.col("html").alias("image"))
    queries = reps.filter("ask").select(F.col("page_id").alias("id"), F.col("html").alias("image"))
    match = copies(images, queries, drawn, edit_queries=True)
    none = F.lit(None)
    members = named.select(F.lit("member").alias("kind"), F.lit(None).cast("long").alias("query_id"), "page_id", "class_id", none.cast("long").alias("votes"), none.cast("double").alias("scale"), none.cast("double").alias("turn"), none.cast("double").alias("dx"), none.cast("double").alias("dy"))
    found = match.select(F.lit("match").alias("kind"), "query_id", F.col("id").alias("page_id"), F.col("id").alias("class_id"), "votes", "scale", "turn", "dx", "dy")
    return members.unionByName(found)


def op6_image_copies(spark, sf_dir: str) -> DataFrame:
    return page_copies(table(spark, sf_dir, "pages"))
