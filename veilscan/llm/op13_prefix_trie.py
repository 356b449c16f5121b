"""Prefix trie of conversations: which beginnings are shared, and what sharing them saves.

Every distinct sequence of first turns is a node. Turns become digests at once, so no text is shuffled. Conversations
are sorted over ranges that may cut one of them; running sums in each range, with what the ranges before it carry over,
number the turns and give a 128-bit key of each prefix. So a conversation of any length is many tasks. Nodes are counted
by key.

A chain of nodes with the same members is one node of the compressed trie, named by its last node: conversations that
leave a path at k places have k * k / 2 turns at least, so a path has at most about the root of twice the number of rows
of such nodes. Conversations are sorted by these paths and dealt into shards. A shard writes its part of the compressed
trie as balanced parentheses in preorder: findclose, over a tree of minima of the excess in blocks, delimits subtrees;
the rank of leaf pairs counts their leaves; sums over preorder give their savings. Nodes on a shard's first and last
path may go on in other shards: their parts are merged by key. What is the same in a chain is then put back on its nodes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, table, written

#: Conversations of one shard, and bits of one block of excess.
SHARD, BITS = 1 << 16, 64
#: Nodes that more conversations share than this part of all rows go to every task: 1 / SHARE of them at most.
SHARE, LEAST_HEAVY = 1e-5, 1000
_EMPTY = hashlib.sha256(b"").hexdigest()
_KEY = ["a", "b", "d"]


def digested(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, size): 16 bytes that stand for role and text, and the text's code points.

    A null role or text is empty. Rows of a null conv_id belong to no conversation and go. Other columns aren't read."""
    name, content = F.coalesce(turns[role].cast("string"), F.lit("")), F.coalesce(turns[text], F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, content), 256), F.lit(32)))
    rows = turns.select(turns[conv_id].cast("long").alias("conv_id"), turns[turn].cast("long").alias("turn"), digest.alias("digest"), F.length(content).cast("long").alias("size"))
    return rows.filter("conv_id is not null")


def running(rows: DataFrame, by: list, values, names: list[str]) -> DataFrame:
    """``rows`` with sums (modulo 2**64) of ``values(batch)``, an array of as many columns as ``names``, over each
    conversation in order of ``by`` up to the row and, named with a p before, up to the row before it, and ``last``: whether
    the conversation ends there.

    Rows are sorted over ranges and scanned range by range; a conversation that ranges cut gets what its earlier ranges
    sum up to in a second scan. Only the first and last row of each range come to the driver."""
    columns, k = rows.columns, len(names)
    names = [*names, *(f"p{x}" for x in names)]

    def scan(batches):
        from pyspark import TaskContext

        part, conv, carry, held, first = TaskContext.get().partitionId(), None, np.zeros(k, np.uint64), None, True

        def out(cols: list, tail: bool) -> pa.RecordBatch:
            nonlocal first
            marks = np.zeros((2, len(cols[0])), bool)
            marks[0, 0], marks[1, -1], first = first, tail, False
            numbered = [np.full(len(cols[0]), part, np.int32), *cols, *marks]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in numbered], ["part", *columns, *names, "last", "head", "tail"])

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            c = batch.column(columns.index("conv_id")).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[c[0] != conv], c[1:] != c[:-1]])
            begin = np.maximum.accumulate(np.where(starts, np.arange(m), 0))
            own = values(batch)
            sums = np.cumsum(own, axis=0, dtype=np.uint64)
            sums = sums - np.where((begin > 0)[:, None], sums[np.maximum(begin - 1, 0)], np.uint64(0))
            sums[np.cumsum(starts) == 0] += carry
            if held is not None:
                held[-1] = starts[:1]
                yield out(held, False)
            cols = [batch.column(i) for i in range(len(columns))]
            made = [np.ascontiguousarray(x[:, j]).view(np.int64) for x in (sums, sums - own) for j in range(k)]
            cols = [*cols, *made, np.append(starts[1:], False)]
            if m > 1:
                yield out([x[: m - 1] for x in cols], False)
            held = [x[m - 1 :] for x in cols]
            conv, carry = c[-1], sums[-1].copy()
        if held is not None:
            yield out(held, True)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", {x} long" for x in names) + ", last boolean"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = rows.repartitionByRange(n, "conv_id", *by).sortWithinPartitions("conv_id", *by).mapInArrow(scan, f"part int, {kinds}, head boolean, tail boolean")
    scanned = written(scanned)
    edges = scanned.filter("head or tail").select("part", "conv_id", "head", "tail", *names).collect()
    heads, tails = {r["part"]: r["conv_id"] for r in edges if r["head"]}, {r["part"]: r for r in edges if r["tail"]}
    before, ends = {}, set()  # of a range: the conversation that goes on in it with what was summed up before; ranges whose last row ends one
    conv, total = None, np.zeros(k, np.uint64)
    for part, after in zip(order := sorted(heads), [*order[1:], None]):
        if heads[part] == conv:
            before[part] = total
        own = np.array(tails[part][4 : 4 + k], np.int64).view(np.uint64)
        total = own + total if heads[part] == conv == tails[part]["conv_id"] else own
        conv = tails[part]["conv_id"]
        if after is None or heads[after] != conv:
            ends.add(part)

    def move(batches):
        for batch in batches:
            part, cols = batch.column(0).to_numpy(), batch.columns[1:-2]
            c = cols[columns.index("conv_id")].to_numpy(zero_copy_only=False)
            sums = [np.array(cols[len(columns) + j]).view(np.uint64) for j in range(2 * k)]
            for p in np.unique(part).tolist():
                if p in before:
                    mine = (part == p) & (c == heads[p])
                    for j in range(2 * k):
                        sums[j][mine] += before[p][j % k]
            ended = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & np.isin(part, list(ends))
            last = cols[-1].to_numpy(zero_copy_only=False) | ended
            yield pa.RecordBatch.from_arrays([*cols[: len(columns)], *(pa.array(x.view(np.int64)) for x in sums), pa.array(last)], [*columns, *names, "last"])

    return scanned.mapInArrow(move, kinds)


def numbered(rows: DataFrame) -> DataFrame:
    """``digested`` rows with ``i``, the turn's number in its conversation from 1: in order of turn, null first; ties are in order of their digests."""
    return running(rows, ["turn", "digest"], lambda batch: np.ones((batch.num_rows, 1), np.uint64), ["i"]).drop("turn", "pi", "last")


def _lanes(batch: pa.RecordBatch) -> np.ndarray:
    """Two hashes of (number, digest) and the size: sums of the former over a prefix are the prefix's key."""
    at = batch.schema.get_field_index
    d = np.array(batch.column(at("d"))).astype(np.uint64)
    raw = np.frombuffer(b"".join(batch.column(at("digest")).to_pylist()), "<u8").reshape(len(d), 2)
    return np.stack([mix(mix(raw[:, 0] + d * np.uint64(0x9E3779B97F4A7C15)) ^ raw[:, 1]), mix(mix(raw[:, 1] + d * np.uint64(0xC2B2AE3D27D4EB4F)) ^ raw[:, 0]), np.array(batch.column(at("size"))).astype(np.uint64)], axis=1)


def close_of(bits: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The closing parenthesis of each opening one of a balanced sequence: the first later place where the excess falls
    below that at the opening one. Blocks' minima stand in a tree; a search looks through its own block, climbs to the
    first subtree on the right whose minimum is low enough, descends in it, and looks through one block more."""
    excess = np.cumsum(np.where(bits, 1, -1))
    blocks = -(-len(bits) // BITS)
    leaves = 1 << max(blocks - 1, 0).bit_length()
    padded = np.full(leaves * BITS, np.iinfo(np.int64).max)
    padded[: len(bits)] = excess
    padded = padded.reshape(leaves, BITS)
    tree = np.full(2 * leaves, np.iinfo(np.int64).max)
    tree[leaves:] = padded.min(axis=1)
    for node in (1 << level for level in range(leaves.bit_length() - 2, -1, -1)):
        tree[node : 2 * node] = np.minimum(tree[2 * node : 4 * node : 2], tree[2 * node + 1 : 4 * node : 2])
    below = excess[opens]
    out = np.full(len(opens), -1)
    for lo in range(0, len(opens), SHARD):
        block, level, target = opens[lo : lo + SHARD] // BITS, opens[lo : lo + SHARD] % BITS, below[lo : lo + SHARD]
        low = (padded[block] < target[:, None]) & (np.arange(BITS) > level[:, None])
        found = low.any(axis=1)
        got = block * BITS + low.argmax(axis=1)
        node = block + leaves
        active = np.flatnonzero(~found)
        while len(active):  # up: a left child whose right neighbour is low enough ends the climb
            right = node[active] ^ 1
            ends = (node[active] % 2 == 0) & (tree[right] < target[active])
            node[active] = np.where(ends, right, node[active] // 2)
            active = active[~ends]
        active = np.flatnonzero(~found)
        while len(active := active[node[active] < leaves]):  # down, to the left where it can
            left = 2 * node[active]
            node[active] = np.where(tree[left] < target[active], left, left + 1)
        rest = np.flatnonzero(~found)
        got[rest] = (node[rest] - leaves) * BITS + (padded[node[rest] - leaves] < target[rest, None]).argmax(axis=1)
        out[lo : lo + SHARD] = got
    return out


_PART = (
    "kind string, a long, b long, d long, conv long, n long, parent_conv long, head long, upto long, leaf boolean, weight long, leaves long, below long, "
    "ends_sha256 string, above array<struct<a:long,b:long,d:long>>, shard long, ids string"
)


def _shard(conv: np.ndarray, tail: np.ndarray, at: np.ndarray, path: dict[str, np.ndarray], root: dict, number: int):
    """Rows of one shard: sorted conversations, whether each goes on alone after its path, and where its path begins in ``path``.

    ``node``: whole statistics of a node; ``part``: what this shard knows of a node that other shards may hold too, without
    what is below other such nodes; ``ends``: ids that end in such a node here."""
    m, size, rows = len(conv), np.diff(at), int(at[-1])
    row = np.repeat(np.arange(m), size)
    j = np.arange(rows) - at[row]
    # a path's nodes are new from the first that differs from the path before
    before = np.maximum(row - 1, 0)
    same = (row > 0) & (j < size[before])
    other = np.where(same, at[before] + j, 0)
    for x in _KEY:
        same &= path[x] == path[x][other]
    shared = size.copy()
    np.minimum.at(shared, row[~same], j[~same])
    new = np.flatnonzero(j >= shared[row])
    # preorder: the root, then of each conversation its new nodes and what it goes on with alone
    per = size - shared + tail
    first = 1 + np.cumsum(per) - per
    total = 1 + int(per.sum())
    alone = np.flatnonzero(tail)
    of = np.zeros(rows, np.int64)  # the number of each row's node; what isn't new is the path before's
    of[new] = first[row[new]] + j[new] - shared[row[new]]
    for k in range(int(size.max(initial=0))):
        mine = np.flatnonzero(size > k)
        fresh = np.maximum.accumulate(np.where(shared[mine] <= k, np.arange(len(mine)), 0))
        of[at[mine] + k] = of[at[mine[fresh]] + k]
    end = np.zeros(m, np.int64)
    end[size > 0] = of[at[1:][size > 0] - 1]
    level, parent = np.zeros(total, np.int64), np.zeros(total, np.int64)
    node = {x: np.full(total, root[x]) for x in ("a", "b", "d", "conv", "n", "upto", "leaf")}
    level[of[new]], parent[of[new]] = j[new] + 1, np.where(j[new] > 0, of[np.maximum(new - 1, 0)], 0)
    for x in node:
        node[x][of[new]] = path[x][new]
    lone = first[alone] + per[alone] - 1
    level[lone], parent[lone] = size[alone] + 1, end[alone]
    for x, value in (("a", 0), ("b", 0), ("d", -1), ("conv", conv[alone]), ("n", 1), ("upto", 0), ("leaf", True)):
        node[x][lone] = value

    # before a node opens, all nodes before it have opened, and of these all but its ancestors have closed
    opens = 2 * np.arange(total) - level
    bits = np.zeros(2 * total, bool)
    bits[opens] = True
    past = np.arange(total) + (close_of(bits, opens) - opens + 1) // 2  # the number past its subtree
    weight = (node["n"] - 1) * (node["upto"] - node["upto"][parent])
    weight[0] = 0
    shared_on = np.zeros(total, bool)
    shared_on[[0, *of[: at[1]], *of[at[-2] :]]] = True
    leaf = ~np.append(bits, False)[opens + 1] & ~shared_on
    rank, saved = (np.concatenate([[0], np.cumsum(x)]) for x in (leaf, np.where(shared_on, 0, weight)))
    leaves, below = rank[past] - rank[:-1], saved[past] - saved[1:]
    ended = np.flatnonzero(~tail)  # those that end in one node follow one another
    ids = {int(end[run[0]]): ",".join(map(str, conv[run].tolist())) for run in np.split(ended, np.flatnonzero(np.diff(end[ended])) + 1) if len(run)}

    head, parent_conv = node["d"][parent] + 1, node["conv"][parent]
    chosen = np.flatnonzero(~shared_on)
    lonely = np.zeros(total, bool)
    lonely[lone] = True
    for lo in range(0, len(chosen), 8192):
        c = chosen[lo : lo + 8192]
        sha = [_sha256(str(w) if own else ids.get(x, "")) for x, own, w in zip(c.tolist(), lonely[c].tolist(), node["conv"][c].tolist())]
        yield _batch("node", node, c, parent_conv[c], head[c], weight[c], leaves[c], below[c], sha, [None] * len(c), number, [None] * len(c))
    parts = np.flatnonzero(shared_on)
    leaves, below = leaves.copy(), below.copy()
    for x in parts[1:]:  # in preorder: a parent's own numbers are taken off before its children's are
        leaves[parent[x]] -= rank[past[x]] - rank[x]
        below[parent[x]] -= saved[past[x]] - saved[x + 1]
    above = []
    for x in parts.tolist():
        above.append([])
        while x:
            x = int(parent[x])
            above[-1].append({y: int(node[y][x]) for y in _KEY})
    yield _batch("part", node, parts, parent_conv[parts], head[parts], weight[parts], leaves[parts], below[parts], [None] * len(parts), above, number, [ids.get(x) for x in parts.tolist()])


def _sha256(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _batch(kind, node, c, parent_conv, head, weight, leaves, below, sha, above, number, ids) -> pa.RecordBatch:
    key = pa.list_(pa.struct([(x, pa.int64()) for x in _KEY]))
    long = lambda x: pa.array(np.asarray(x, np.int64))
    cols = {"kind": pa.array([kind] * len(c))} | {x: long(node[x][c]) for x in (*_KEY, "conv", "n")} | {"parent_conv": long(parent_conv), "head": long(head), "upto": long(node["upto"][c])}
    cols |= {"leaf": pa.array(node["leaf"][c].astype(bool)), "weight": long(weight), "leaves": long(leaves), "below": long(below), "ends_sha256": pa.array(sha, pa.string()), "above": pa.array(above, key)}
    cols |= {"shard": long(np.full(len(c), number)), "ids": pa.array(ids, pa.string())}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _hash_ids(batches):
    """SHA-256 of each node's ids, whose pieces follow one another in order of shards, comma-joined."""
    key, state, done = None, None, []
    for batch in batches:
        for *k, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if k != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) >= 4096:
            yield _hashes(done)
            done = []
    if key is not None:
        done.append((*key, state.hexdigest()))
    if done:
        yield _hashes(done)


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),))], [*_KEY, "ends_sha256"])


def nodes(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A row for each node of the trie of rows (conv_id, d, digest, size): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; the root has depth 0 and a null parent.

    ``members``: all conversations (conv_id), those without a turn too; else those that have turns. Copies of a conversation
    share all their nodes and end in the same one. Without conversations there is no root and no row."""
    spark = turns.sparkSession
    rows = written(running(turns, ["d"], _lanes, ["a", "b", "upto"]).drop("digest", "pupto"))
    everyone = written((rows if members is None else members).select("conv_id").filter("conv_id is not null").distinct())
    whole = everyone.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")).first()
    counted = rows.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.count_if("last").alias("ends"), F.min("size").alias("size"), F.min("upto").alias("upto"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    counted = written(counted)
    kids = counted.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    both = written(counted.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("pa", "pb"))
    n_children = both.filter("d = 1").count()
    root = {"a": 0, "b": 0, "d": 0, "conv": whole["conv"] or 0, "n": whole["n"], "upto": 0, "leaf": n_children == 0}

    # paths of shared chains' last nodes; nodes that very many conversations share go to every task
    stops = both.filter("n > 1 and (ends > 0 or n_children <> 1)").select(*_KEY, "n", "conv", "upto", (F.col("n_children") == 0).alias("leaf"))
    heavy = F.col("n") > max(LEAST_HEAVY, int(SHARE * (both.agg(F.sum("n")).first()[0] or 0)))
    entry = F.struct("d", "a", "b", "n", "conv", "upto", "leaf")
    mine = rows.select("conv_id", *_KEY).join(F.broadcast(stops.filter(heavy).select(*_KEY, entry.alias("e"))), _KEY, "left")
    light = mine.filter("e is null").drop("e").join(stops.filter(~heavy).select(*_KEY, entry.alias("e")), _KEY)
    paths = mine.filter("e is not null").select("conv_id", "e").unionByName(light.select("conv_id", "e"))
    paths = paths.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("path"))
    sizes = rows.filter("last").select("conv_id", F.col("d").alias("turns"))
    convs = everyone.join(sizes, "conv_id", "left").join(paths, "conv_id", "left").withColumn("path", F.coalesce("path", F.array().cast(paths.schema["path"].dataType)))
    convs = convs.withColumn("tail", F.coalesce("turns", F.lit(0)) > F.coalesce(F.try_element_at("path", F.lit(-1))["d"], F.lit(0))).select("path", "tail", "conv_id")

    def shards(batches):
        from pyspark import TaskContext

        part, held, count, number = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= SHARD:
                yield from build(held, (part << 33) + number)
                held, count, number = [], 0, number + 1
        if count:
            yield from build(held, (part << 33) + number)

    def build(batches, number):
        t = pa.Table.from_batches(batches).combine_chunks()
        path, tail, conv = (t.column(i).combine_chunks() for i in range(3))
        path = path if isinstance(path, pa.Array) else path.chunk(0)
        entries = path.flatten()
        at = np.concatenate([[0], np.cumsum(np.array(path.value_lengths()))]).astype(np.int64)
        flat = {x: np.array(entries.field(x).to_numpy(zero_copy_only=False)) for x in (*_KEY, "n", "conv", "upto", "leaf")}
        return _shard(conv.to_numpy(zero_copy_only=False), tail.to_numpy(zero_copy_only=False), at, flat, root, number)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = convs.repartitionByRange(parts, "path", "tail", "conv_id").sortWithinPartitions("path", "tail", "conv_id")
    made = written(dealt.mapInArrow(shards, _PART))

    # nodes that shards share: each one's own numbers once, and to all above what they hold
    spine = made.filter("kind = 'part'")
    one = spine.groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below"), *[F.first(x).alias(x) for x in ("conv", "n", "parent_conv", "head", "upto", "leaf", "weight", "above")])
    mark = F.col("leaf").cast("long")
    to_self = one.select(*_KEY, (F.col("leaves") + mark).alias("leaves"), "below", F.struct("conv", "n", "parent_conv", "head", "upto").alias("own"))
    to_above = one.select((F.col("leaves") + mark).alias("leaves"), (F.col("below") + F.col("weight")).alias("below"), F.explode("above").alias("k")).select("k.*", "leaves", "below", F.lit(None).cast(to_self.schema["own"].dataType).alias("own"))
    summed = to_self.unionByName(to_above).groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below"), F.max("own").alias("own"))
    pieces = spine.filter("ids is not null").select(*_KEY, "shard", "ids").repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "shard")
    hashes = pieces.mapInArrow(_hash_ids, "a long, b long, d long, ends_sha256 string")
    merged = summed.join(hashes, _KEY, "left").select(*_KEY, "own.*", "leaves", "below", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    chains = merged.unionByName(made.filter("kind = 'node'").select(*merged.columns))
    chains = written(chains.select("conv", "n", "head", F.when(F.col("d") >= 0, F.col("d")).alias("stop"), "parent_conv", "upto", "leaves", "below", "ends_sha256"))

    # back on every node: chains of one conversation are told apart by how many share them
    out = lambda df, parent, leaves, saved, ends: df.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), ends.alias("ends_sha256"))
    of_chain = chains.filter("n > 1 and stop > 0").select("conv", "n", "head", "stop", "parent_conv", F.col("upto").alias("all"), "leaves", "below", F.col("ends_sha256").alias("at_stop"))
    several = both.filter("n > 1").join(of_chain, ["conv", "n"])
    up = F.when(F.col("d") == F.col("head"), F.col("parent_conv")).otherwise(F.col("conv"))
    saved = F.col("below") + (F.col("n") - 1) * (F.col("all") - F.col("upto") + F.col("size"))
    shared = out(several, up, F.col("leaves"), saved, F.when(F.col("d") == F.col("stop"), F.col("at_stop")).otherwise(F.lit(_EMPTY)))
    heads = chains.filter("n = 1 and (stop is null or stop > 0)").select("conv", F.col("head").alias("d"), "parent_conv")
    single = both.filter("n = 1").join(heads, ["conv", "d"], "left")
    alone = out(single, F.coalesce("parent_conv", "conv"), F.lit(1), F.lit(0), F.when(F.col("ends") > 0, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_EMPTY)))
    top = chains.filter("stop = 0").select("conv", F.lit(0).cast("long").alias("d"), "n", F.lit(n_children).alias("n_children"), "leaves", "below", "ends_sha256")
    top = out(top, F.lit(None).cast("long"), F.col("leaves"), F.col("below"), F.col("ends_sha256"))
    return top.unionByName(shared).unionByName(alone)


def trie(turns: DataFrame, **columns: str) -> DataFrame:
    """``nodes`` of conversations as they are: rows of conv_id, turn, role and text (their names may be given). A null turn
    comes first; see ``digested`` and ``numbered`` for nulls and ties. Repeated rows are turns of their own."""
    return nodes(numbered(digested(turns, **columns)).withColumnRenamed("i", "d"))


def _shared_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(6))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, d, digest, size) of conversations of numbered turns with a beginning taken from another: the first h turns
    of conversation c - c % 100, then c's own after its first h; h is crc32(c as text) % 6. % keeps the sign of c."""
    sizes = turns.groupBy("conv_id").agg(F.max("i").alias("turns"))
    base = F.col("conv_id") - F.col("conv_id") % 100
    wants = sizes.select("conv_id", base.alias("base"), _shared_turns(F.col("conv_id")).alias("h"))
    firsts = turns.filter("i <= 5").select(F.col("conv_id").alias("base"), "i", "digest", "size")
    front = wants.join(firsts, "base").filter("i <= h").select("conv_id", F.col("i").alias("d"), "digest", "size")
    # how many of its first turns a base has: it may not be there, and only lacks when it has fewer than five
    short = sizes.filter(F.col("turns") >= 1).select(F.col("conv_id").alias("base"), F.least("turns", F.lit(5)).alias("has"))
    given = wants.join(short, "base", "left").select("conv_id", F.least("h", F.coalesce("has", F.lit(0))).alias("given"))
    own = turns.filter(F.col("i") > _shared_turns(F.col("conv_id"))).join(given, "conv_id")
    own = own.select("conv_id", (F.col("i") - _shared_turns(F.col("conv_id")) + F.col("given")).alias("d"), "digest", "size")
    return front.unionByName(own)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = written(numbered(digested(table(spark, sf_dir, "conversations"))))
    return nodes(rebuilt(turns), turns.select("conv_id"))


#: CRC-32 of a text of digits, bit by bit.
_CRC = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda s, x: list_reduce([xor(s, x)] || [CAST(0 AS BIGINT) for k in range(8)], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"
SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS has, CAST({_CRC.format(c='c')} % 6 AS BIGINT) AS h FROM t GROUP BY c),
m AS (SELECT s.c, s.h, s.c - s.c % 100 AS base, least(s.h, coalesce(b.has, 0)) AS given FROM s LEFT JOIN s b ON b.c = s.c - s.c % 100),
r AS (SELECT m.c, t.i AS d, t.role, t.text FROM m JOIN t ON t.c = m.base AND t.i <= m.h
  UNION ALL SELECT m.c, t.i - m.h + m.given, t.role, t.text FROM m JOIN t ON t.c = m.c AND t.i > m.h),
k AS (SELECT c, d, length(text) AS size, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM m),
g AS (SELECT *, sha256(path) AS key, d = max(d) OVER (PARTITION BY c) AS last, lag(sha256(path)) OVER (PARTITION BY c ORDER BY d) AS parent FROM k),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, min(parent) AS parent, min(size) AS size,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM g GROUP BY key, d),
x AS (SELECT n.*, (SELECT count(*) FROM n y WHERE y.parent = n.key) AS n_children FROM n),
b AS (SELECT u.key, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.size) AS saved
  FROM x JOIN g ON g.c = x.conv_id AND g.key = x.key JOIN g u ON u.c = g.c AND u.d <= g.d GROUP BY u.key)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN b ON b.key = x.key LEFT JOIN n p ON p.key = x.parent
"""
