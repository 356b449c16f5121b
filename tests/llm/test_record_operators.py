"""WARC chunks, chat rotation, image copies and the pipeline, with nulls, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from veilscan.llm import op6_image_copies, op8_warc, op9_chat_format
from veilscan.llm.common import with_groups, written

PAGES = "page_id long, url string, html string, chunk int, digest string"


def pages(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("abc é\n\r") for _ in range(5000))
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\r\nX: 1", None), (4, "u", ""), (5, "u", big), (9, "u", big), (9, "u", big), (None, "u", "x"), (None, "u", "alone"), (7, "u", "WARC/1.1\r\n\r\n"), (8, "u", "é" * 40)]
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], PAGES)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
@pytest.mark.parametrize("least, most", [(0, 100), (3, 100), (0, 0)])
def test_warc_round_trip(spark, chunk, least, most):
    p = pages(spark)
    table = written(op8_warc.to_chunks(p, chunk=chunk, least_bytes=least, most=most))
    assert max(r["n"] for r in table.select(F.octet_length("data").alias("n")).collect()) <= chunk + 600
    got = sorted(op8_warc.from_chunks(table).collect(), key=str)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in p.collect()]
    want = []
    for i, payload in rows:
        same = [j for j, x in rows if x == payload and j is not None]
        response = max(same) if same and len(payload) >= least and sum(x == payload for _, x in rows) > 1 else None
        own = response is None or i == response
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if own else "revisit", None if own else response))
    assert [tuple(r) for r in got] == sorted(want, key=str)
    assert op8_warc.from_chunks(written(op8_warc.to_chunks(p.limit(0)))).count() == 0


def test_rows_of_a_common_key_are_dealt_over_tasks(spark):
    rows = spark.range(4000, numPartitions=4).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) as digest", "'same' as url", "id as __part")
    groups = written(spark.createDataFrame([("hot", 7), ("k1", 8)], "digest string, response_id int"))
    split, plain = (with_groups(rows, groups, "digest", ["url", "__part"], most) for most in (1, 2))
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert split.columns == plain.columns
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in with_groups(rows, groups, "digest", ["url", "__part"], 1).filter("digest = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and sum(sizes) == 1334


def test_warc_reader_notices_damage(spark):
    table = op8_warc.to_chunks(pages(spark), chunk=64).filter("octet_length(data) > 0").toPandas()
    long = table.groupby("record").filter(lambda g: len(g) > 3)
    record = long["record"].iloc[0]
    lost = table[~((table["record"] == record) & (table["chunk"] == 2))]
    with pytest.raises(Exception, match="is missing"):
        op8_warc.from_chunks(spark.createDataFrame(lost, op8_warc.CHUNKS)).collect()


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", "hé"), (1, 2, "assistant", "B"), (1, 2, "assistant", "A"), (1, None, "user", None), (1, 200, "bob", "x"), (2, 0, "system", "only"), (None, 0, None, "q"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("name", F.lit("clash"))
    got = op9_chat_format.rotate(df).collect()
    want = []
    for conv in {t[0] for t in turns}:
        own = [(t[1], t[2] or "unknown", t[3] or "") for t in turns if t[0] == conv]
        for who in {o[1] for o in own} - {"system"}:
            lines = []
            for turn, name, text in own:
                role = "system" if name == "system" else "assistant" if name == who else "user"
                head = f"<|start|>{role}" + (f" name={name}" if role == "user" else "") + "\n"
                lines.append((turn is not None, turn or 0, name, head + text + "<|end|>\n", turn, role, len(head)))
            at = 0
            for _, _, name, rendered, turn, role, head in sorted(lines, key=lambda x: x[:4]):
                mask = (at + head, at + len(rendered) - 1, 1) if role == "assistant" else (None, None, 0)
                want.append((conv, who, turn, role, name, rendered, at, at + len(rendered), *mask))
                at += len(rendered)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "assistant"), key=lambda r: r["char_start"]))
    assert [whole[r["mask_start"] : r["mask_end"]] for r in got if r["conv_id"] == 1 and r["perspective"] == "assistant" and r["learn"]].count("A<|end|>") == 1
    assert op9_chat_format.rotate(df.limit(0)).count() == 0


def html(rng, n=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_image_copies_are_found(spark):
    rng = random.Random(8)
    texts = [html(rng) for _ in range(400)]
    rows = [(i, texts[i]) for i in range(400)] + [(1000, texts[7]), (1000, texts[7]), (1001, None), (1002, ""), (None, texts[9]), (1100, "plain")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("id", F.lit("clash"))
    got = op6_image_copies.page_copies(df, every=10).collect()
    members = {r["page_id"]: r["class_id"] for r in got if r["kind"] == "member"}
    assert len([r for r in got if r["kind"] == "member"]) == len(rows)
    assert members[1000] == 7 and members[1002] == 1001 and members[None] == 9
    found = {(r["query_id"], r["page_id"]) for r in got if r["kind"] == "match"}
    queries = {i for i in range(0, 400, 10)} | {7, 1100}
    assert all(q == p for q, p in found) and {q for q, _ in found} <= queries
    assert len(found) >= 0.9 * len(queries)


def texture(rng, side=128, cells=32):
    stretch = op6_image_copies._grown(cells, side)
    return np.clip(stretch @ rng.integers(0, 255, (cells, cells)).astype(np.float32) @ stretch.T, 0, 255).astype(np.uint8)


def turned(x, degrees):
    """An image turned about its middle, between pixels by their neighbours; grey where nothing was."""
    n, t = len(x), np.deg2rad(degrees)
    yy, xx = np.mgrid[:n, :n] - (n - 1) / 2
    sx, sy = np.cos(t) * xx + np.sin(t) * yy + (n - 1) / 2, -np.sin(t) * xx + np.cos(t) * yy + (n - 1) / 2
    inside = (sx >= 0) & (sx <= n - 1) & (sy >= 0) & (sy <= n - 1)
    i, j = np.clip(sy.astype(int), 0, n - 2), np.clip(sx.astype(int), 0, n - 2)
    fy, fx = sy - i, sx - j
    x = x.astype(float)
    v = (x[i, j] * (1 - fx) + x[i, j + 1] * fx) * (1 - fy) + (x[i + 1, j] * (1 - fx) + x[i + 1, j + 1] * fx) * fy
    return np.where(inside, v, 128).astype(np.uint8)


def best_votes(a, b, keyed=True):
    """The most votes of query b's corners for a place in image a, a pair of descriptors at a time: those that share a key, or all."""
    o = op6_image_copies
    differ = np.bitwise_count((a["d0"][:, None] ^ b["d0"]).view(np.uint64)).astype(int) + np.bitwise_count((a["d1"][:, None] ^ b["d1"]).view(np.uint64))
    share = np.any([x[:, None] == y for x, y in zip(o.keys(a["d0"], a["d1"]), o.keys(b["d0"], b["d1"]))], axis=0)
    i, j = np.nonzero((share | (not keyed)) & (differ <= o.DIFFER))
    cx, cy = b["x"].mean(dtype=float), b["y"].mean(dtype=float)
    votes = {}
    for m, k in zip(i.tolist(), j.tolist()):
        scale = round(o.SCALES[b["level"][k]] / o.SCALES[a["level"][m]], 6)
        for off in (-1, 0, 1):
            turn = (int(a["turn"][m]) - int(b["turn"][k]) + off) % o.TURNS
            c, s = np.cos(o._ANGLES[turn]), np.sin(o._ANGLES[turn])
            qx, qy = float(b["x"][k]) - cx, float(b["y"][k]) - cy
            dx, dy = float(a["x"][m]) - scale * (c * qx - s * qy), float(a["y"][m]) - scale * (s * qx + c * qy)
            for ox in (0, o.SLACK / 2):
                for oy in (0, o.SLACK / 2):
                    votes.setdefault((scale, turn, ox, oy, (dx + ox) // o.SLACK, (dy + oy) // o.SLACK), set()).add(k)
    return max((len(v) for v in votes.values()), default=0)


def test_edited_copies_are_found(spark):
    """Half as large, smaller, cropped and turned copies with noise: matches are those of a plain loop over pairs that share
    a key, and nearly all that a loop over every pair finds."""
    o, rng = op6_image_copies, np.random.default_rng(12)
    big = [texture(rng) for _ in range(16)]
    noised = lambda x: np.clip(x + rng.normal(0, 3, x.shape), 0, 255).astype(np.uint8)
    asked = {}
    for i, x in enumerate(big):
        asked[i] = noised(x.reshape(64, 2, 64, 2).mean((1, 3)))
        asked[100 + i] = noised(o._shrunk(128, 96) @ x.astype(np.float32) @ o._shrunk(128, 96).T)
        asked[200 + i] = noised(x[:110, 10:120])
        asked[300 + i] = noised(np.rot90(x))
        asked[400 + i] = noised(turned(x, 30))
    frame = lambda rows: spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in rows], "id long, image binary")
    images, queries = frame(enumerate(big)), frame(asked.items())
    got = o.copies(images, queries).collect()
    found = {(r["query_id"], r["id"]): r["votes"] for r in got}
    at = {i: o.describe(x[None])[1] for i, x in enumerate(big)}
    described = {q: o.describe(x[None])[1] for q, x in asked.items()}
    want = {(q, i): best_votes(at[i], d) for q, d in described.items() for i in at}
    assert found.keys() == {k for k, v in want.items() if v >= o.VOTES}
    assert np.mean([found[k] == want[k] for k in found]) > 0.95  # a vote may lie on the border of a cell
    whole = [(q, q % 100) for q in asked if best_votes(at[q % 100], described[q], keyed=False) >= o.VOTES]
    assert len([k for k in whole if k in found]) >= 0.9 * len(whole) >= 0.85 * len(asked)
    for kind, scale, turn in ((0, 2.0, 0), (100, 1.333, 0), (200, 1.0, 0), (300, 1.0, 90.0), (400, 1.0, None)):
        own = [r for r in got if r["query_id"] // 100 * 100 == kind and r["query_id"] % 100 == r["id"]]
        assert len(own) >= 14, kind
        assert {r["scale"] for r in own} == {scale}
        assert all(turn is None or min(abs(r["turn"] - turn), 360 - abs(r["turn"] - turn)) <= 11.25 for r in own), kind
    assert all(q % 100 == i for q, i in found)
    assert {(r["query_id"], r["id"], r["votes"]) for r in o.copies(images, queries, block=7).collect()} == {(r["query_id"], r["id"], r["votes"]) for r in got}
    assert o.copies(images, images.limit(0)).count() == 0


def test_every_corner_is_described():
    """Corners are those of a plain loop over pixels, without a bound on their number."""
    o, rng = op6_image_copies, np.random.default_rng(4)
    x = texture(rng, 160, 60)
    number, found = o.describe(np.stack([np.full_like(x, 9), x]))
    assert (number == 1).all() and len(found) > 150
    f = x.astype(np.float32)
    box = sum(f[i : i + 158, j : j + 158] for i in range(3) for j in range(3)) / 9
    gx, gy = (box[1:-1, 2:] - box[1:-1, :-2]) / 2, (box[2:, 1:-1] - box[:-2, 1:-1]) / 2
    five = lambda g: sum(g[i : i + 152, j : j + 152] for i in range(5) for j in range(5))
    xx, yy, xy = five(gx * gx), five(gy * gy), five(gx * gy)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    want = {(px, py) for py in range(o.MARGIN, 160 - o.MARGIN) for px in range(o.MARGIN, 160 - o.MARGIN) if r[py - 4, px - 4] > o.STRENGTH and r[py - 4, px - 4] == r[py - 5 : py - 2, px - 5 : px - 2].max()}
    got = {(int(c["x"]), int(c["y"])) for c in found if c["level"] == 0}
    assert len(got ^ want) <= 2


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, now = docs, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = written(stage(spark, before, d))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns and 0 < now.count() <= before.count(), name
            before = now
    assert now.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert now.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).filter("n <> t").count() == 0


def folder(spark, tmp_path, docs, labels, benchmark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_against_plain_loops(spark, tmp_path):
    """Rows with nulls, empty and long texts, repeats and columns of clashing names go through each stage as loops say."""
    import zlib

    import corpus_pipeline
    from test_text_operators import brute_classes, plain_language, plain_score, prose, wordlist

    from veilscan.llm import op4_toxicity
    from veilscan.llm.common import table

    rng = random.Random(31)
    rows = [(i, prose(rng, rng.randint(12, 80)) + (" vile" * 3 if i % 4 == 0 else ""), "aa") for i in range(160)]
    rows += [(200 + i, " ".join(rng.choice(["über", "schön", "nicht"]) for _ in range(20)), "bb") for i in range(30)]
    item = prose(rng, 14)
    rows += [(300, None, None), (301, "", "aa"), (302, "12 - 7", None), (303, rows[3][1] + " " + rows[5][1] + " " + item, "aa"), (None, rows[7][1], "aa"), (7, rows[7][1], "aa"), (304, prose(rng, 20000), "aa"), rows[9], (305, " ".join([*rows[11][1].split()[:-1], "other"]), None)]
    docs = spark.createDataFrame([(*r, k, "x", {"a": 1}) for k, r in enumerate(rows)], "doc_id long, text string, lang string, __language int, __t string, __leak map<string,int>")
    d = folder(spark, tmp_path, docs, [(i, int(i % 4 == 0)) for i in range(160)], [(1, item), (2, None)])
    docs = table(spark, d, "documents")
    stages = dict(corpus_pipeline.STAGES)
    numbers = lambda df: sorted(r["__language"] for r in df.collect())

    kept = stages["language"](spark, docs, d)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert numbers(kept) == [k for k, r in enumerate(plain_language(rows)) if r[3]]

    labels = table(spark, d, "labels")
    model = op4_toxicity.train(*op4_toxicity.sample(docs, labels, "doc_id", "text", "toxic", op4_toxicity.SAMPLE, op4_toxicity.SAMPLE_BYTES, 5, 0))
    kept = stages["toxicity"](spark, docs, d)
    assert kept.schema == docs.schema
    got = numbers(kept)
    assert got == [k for k, r in enumerate(rows) if plain_score(r[1], *model) < 0.5]
    held = [k for k in range(160) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((k not in got) == (k % 4 == 0) for k in held) >= 0.9 * len(held)

    kept = stages["near_duplicates"](spark, docs, d)
    assert kept.schema == docs.schema
    groups = {}
    for k, (r, c) in enumerate(zip(rows, brute_classes([(r[0], r[1]) for r in rows]))):
        groups.setdefault(c if wordlist(r[1]) else -k - 1, []).append(k)
    first = lambda g: min((rows[k][0] is None, rows[k][0] or 0) for k in g)
    got = numbers(kept)
    assert len(got) == len(groups)
    for g in groups.values():
        chosen = [k for k in got if k in g]
        assert len(chosen) == 1 and (rows[chosen[0]][0] is None, rows[chosen[0]][0] or 0) == first(g)

    kept = stages["decontamination"](spark, docs, d)
    assert kept.schema == docs.schema
    w = wordlist(item)
    windows = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    hit = lambda v: any(tuple(v[i : i + 10]) in windows for i in range(len(v) - 9))
    assert numbers(kept) == [k for k, r in enumerate(rows) if not hit(wordlist(r[1]))]
    assert 193 not in numbers(kept)

    packed = stages["packing"](spark, docs, d)
    total = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(total) == {r[0] for r in rows} and total[300] == total[301] == 1


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    from veilscan.llm.common import table

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d = folder(spark, tmp_path, docs, [], [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, d, "documents"), d).count() == 0, name
    assert corpus_pipeline.run(spark, d).count() == 0


def test_documents_stay_where_no_language_was_learned(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None), (2, "7", None), (3, None, None)], "doc_id long, text string, lang string")
    d = folder(spark, tmp_path, docs, [], [])
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, d).collect()] == [1]


def test_clusters_must_name_a_shared_folder(spark):
    from veilscan.sources import scratch

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert scratch.shared_dir(Session) == scratch.shared_dir(Session)


def test_plain_images_have_no_corners():
    assert all(len(x) == 0 for x in op6_image_copies.describe(np.zeros((2, 64, 64), np.uint8)))
    assert all(len(x) == 0 for x in op6_image_copies.describe(np.zeros((1, 8, 8), np.uint8)))
