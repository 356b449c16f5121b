"""Operators 11 to 13 against the tiktoken library, a dense eigensolver and a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilscan.llm import op11_bpe as bpe
from veilscan.llm import op12_whitening as white
from veilscan.llm import op13_prefix_trie as trie

PATH = public_tokenizers.path(bpe.VOCABULARY)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})
CODEC = bpe.Codec(bpe.ranks_of(PATH), bpe.classes())
ODD = st.text(st.sampled_from(list("ab '\n\t  strevmld1é漢ß€𝒳 　.,;")), max_size=120)


def test_merges_go_in_order_of_rank():
    assert bpe.in_order(bpe.ranks_of(PATH))
    bytes_alone = {bytes([i]): i for i in range(256)}
    assert bpe.in_order(bytes_alone | {b"ab": 256, b"abc": 257})
    assert not bpe.in_order(bytes_alone | {b"abc": 256, b"bc": 257})  # abc is only reached through a higher rank


def test_pairs_that_fit_prove_nothing_where_merges_go_out_of_order(tmp_path):
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257}
    path = tmp_path / "odd.tiktoken"
    path.write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
    with pytest.raises(ValueError, match="order of rank"):
        bpe._proven(str(path))


@settings(max_examples=120, deadline=None)
@given(ODD | st.text(max_size=60), st.integers(1, 40), st.integers(1, 9))
def test_trees_of_any_leaves_encode_as_the_library(text, piece, match):
    before = bpe.PIECE, bpe.MATCH
    bpe.PIECE, bpe.MATCH = piece, match
    try:
        data = np.frombuffer(text.encode(), np.uint8)
        assert CODEC.long(data).tolist() == LIBRARY.encode_ordinary(text)
    finally:
        bpe.PIECE, bpe.MATCH = before


@settings(max_examples=60, deadline=None)
@given(ODD, st.integers(0, 120), st.integers(0, 120))
def test_neighbours_join_in_any_order(text, i, j):
    i, j = sorted((min(i, len(text)), min(j, len(text))))
    parts = [np.frombuffer(x.encode(), np.uint8) for x in (text[:i], text[i:j], text[j:]) if x]
    if len(parts) < 3:
        return
    a, b, c = map(CODEC.piece, parts)
    plain = lambda x: [y if y is None else y.tolist() for y in x]
    assert plain(CODEC.added(CODEC.added(a, b), c)) == plain(CODEC.added(a, CODEC.added(b, c)))


def test_long_matches_and_texts(spark):
    rng = random.Random(1)
    texts = ["x" * 5000, " " * 4000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(40_000)), "漢字" * 4000, "word " * 20_000, None, "", "'s 'd'll", "<|endoftext|>", "a\n\n\nb  c\n", "same", "same"]
    docs = spark.createDataFrame([(i % 12 if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = bpe.decode(bpe.encode(docs)).select("text", "ids", "bytes", "n_tokens").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == LIBRARY.encode_ordinary(r["text"] or "") and bytes(r["bytes"]) == (r["text"] or "").encode()
    assert bpe.encode(docs.limit(0)).count() == 0
    assert CODEC.decoded(pa.array([None, []], pa.list_(pa.int32()))).to_pylist() == [b"", b""]
    with pytest.raises(ValueError, match="doesn't have"):
        CODEC.decoded(pa.array([[10**6]], pa.list_(pa.int32())))


def test_bpe_query(spark):
    got = {r["doc_id"]: r for r in bpe.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())


@pytest.mark.parametrize("seed", range(8))
def test_slices_of_spectra(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 24))
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    spectra = [rng.random(n), rng.choice([0.0, 1.0, 1.0, 2.0, 5.0], n), 10.0 ** -rng.integers(0, 12, n), np.ones(n), np.zeros(n), 1 + 1e-9 * rng.random(n)]
    for e in spectra:
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        want = np.linalg.eigvalsh(v)[::-1]
        for shift in rng.standard_normal(6):
            assert white.above(v, shift) == (want > shift).sum()
        values, vectors = white.leading(v)
        scale = max(want[0], 1e-300)
        assert np.allclose(values, want[: len(values)], atol=1e-12 * scale)
        assert len(values) == 8 or len(values) == n or want[len(values)] < 1e-12 * scale
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-7) and np.allclose(vectors @ v, values[:, None] * vectors, atol=1e-11 * scale)


def test_whitening_against_a_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(3)
    c = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(c)] + [(5, c[5].tolist(), "again"), (None, c[6].tolist(), "no id")]
    bad = [(900, None, ""), (901, [1.0] * 11 + [None], ""), (902, [float("nan")] * 12, ""), (903, [float("inf")] + [0.0] * 11, ""), (904, [1.0], ""), (905, [], ""), (906, [1e30] * 12, "")]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = white.op12_whitening(spark, str(tmp_path)).toPandas()
    c = np.concatenate([c, c[5:7]])
    x = np.floor(1024 * c.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    assert len(got) == n * 8 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    d = x - s / n
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    y = d @ u / np.sqrt(e)
    assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(d.T @ d / n), rtol=1e-9)
    one = got[got["vec_id"].notna() & (got["vec_id"] != 5)].pivot(index="vec_id", columns="component", values="whitened")
    want = np.delete(y[:700], 5, 0)
    signs = np.sign((one.to_numpy() * want).sum(0))
    assert np.allclose(one.to_numpy() * signs, want, atol=1e-9)
    deviation = got[got["component"] == 1].set_index("vec_id")["deviation"]
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    assert [int(deviation[i]) for i in range(700) if i != 5] == [exact[i] for i in range(700) if i != 5] and set(deviation[5]) == {exact[5]}


def test_whitening_of_few_vectors(spark):
    of = lambda rows: white.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert white.fit(of([])) is None
    same = of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(white.fit(same).values) == 0 and white.whitened(same, white.fit(same)).count() == 0
    line = of([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])
    model = white.fit(line)
    assert len(model.values) == 1 and sorted(round(abs(r["whitened"]), 6) for r in white.whitened(line, model).collect()) == [0.0, 1.224745, 1.224745]
    wide = white.Model(10**9, [10**9 * 5, 0], np.ones(1), np.ones((1, 2)), 1.0)
    assert white._deviations(np.array([[10**4, 0]]), wide) == [None] and white._deviations(np.array([[6, 0]]), wide) == [10**18]


def plain_trie(turns: dict[int, list]) -> list[tuple]:
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in turns.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k in members:
        below = [x for x in members if x[: len(k)] == k]
        ends = sorted(c for c in members[k] if len(turns[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), sum(not kids[x] for x in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard,seed", [(1 << 16, 1), (3, 2)])
def test_trie_is_the_plain_one(spark, monkeypatch, shard, seed):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "LEAST_HEAVY", 10)
    rng = random.Random(seed)
    turns: dict[int, list] = {}
    for c in range(-15, 50):
        s = list(rng.choice(list(turns.values())))[: rng.randint(0, 6)] if turns and rng.random() < 0.4 else []
        while rng.random() < 0.6:
            s.append((rng.choice(["a", ""]), ["", "x", "é𝒳", "yy"][rng.randint(0, 3)]))
        turns[c] = s
    turns |= {c: [("user", "hot")] * 3 for c in range(100, 140)}  # copies
    turns |= {200: [("a", f"t{i}") for i in range(300)], 201: [("a", f"t{i}") for i in range(300)], 202: [("a", f"t{i}") for i in range(150)]}
    rows = [(c, None if i == 0 else i, r or None, t or None, 1) for c, s in turns.items() for i, (r, t) in enumerate(s)] + [(None, 1, "a", "of none", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    members = spark.createDataFrame([(c,) for c in turns] + [(None,)], "conv_id long")
    numbered = trie.numbered(trie.digested(df)).withColumnRenamed("i", "d")
    assert sorted(map(tuple, trie.nodes(numbered, members).collect()), key=str) == sorted(plain_trie(turns), key=str)
    assert trie.trie(df.limit(0)).count() == 0


def test_rebuilt_conversations(spark, tmp_path):
    rng = random.Random(4)
    own = {c: [(rng.choice("ab"), rng.choice(["", "hi", "so", "é"])) for _ in range(rng.randint(1, 7))] for c in [*range(0, 60), *range(100, 105), 203, 204, 207, 299]}
    rows = [(c, i * 2, *t) for c, s in own.items() for i, t in enumerate(s)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + s[h:]
    assert any(not s for s in built.values())
    got = trie.op13_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie(built), key=str)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = got[0].__fields__
    assert sorted((tuple(dict(zip(names, map(r.__getitem__, names))).values()) for r in got), key=str) == sorted((tuple(r[n] for n in names) for r in db.execute(trie.SQL).df().astype(object).where(lambda d: d.notna(), None).to_dict("records")), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=400))
def test_close_of_balanced_parentheses(walk):
    bits, depth = [], 0
    for up in walk:
        if up or depth:
            bits.append(up)
            depth += 1 if up else -1
    bits = np.array([True, *bits, *[False] * depth, False])
    opens, stack, want = np.flatnonzero(bits), [], {}
    for i, b in enumerate(bits.tolist()):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    assert trie.close_of(bits, opens).tolist() == [want[i] for i in opens.tolist()]


def test_running_sums_over_cut_conversations(spark):
    rows = [(c, t, t % 7) for c, n in ((1, 500), (2, 1), (3, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, v long").repartition(3)
    got = trie.running(df, ["turn"], lambda b: np.array(b.column(2)).astype(np.uint64)[:, None], ["s"]).collect()
    want, total = set(), defaultdict(int)
    for c, t, v in rows:
        total[c] += v
        want.add((c, t, v, total[c], total[c] - v, t == {1: 499, 2: 0, 3: 39}[c]))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
