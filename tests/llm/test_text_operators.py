"""Operators over texts against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import common, op1_language_id, op2_token_counts, op3_decontamination, op4_toxicity, op5_packing, op7_license_scan, op10_near_duplicates
from veilscan.llm.tokens import VOCABULARY, encoded, encoder

LOW = str.maketrans(common.UPPER, common.LOWER)
DOCS = "doc_id long, text string, lang string, source string, n_words int, leak string"


def wordlist(text):
    return re.findall(common.WORD, (text or "").translate(LOW))


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", "s", 0, "x") for i in range(60)]
    rows += [(100, None, None, None, None, None), (101, "", "en", None, 1, None), (102, "  \n ", None, "s", 1, ""), (103, "Ünïcode ñandú DÉJÀ! 42", "es", "s", 0, "")]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "s", 0, "")]
    rows += [(200, rows[5][1] + " tail", "en", "s", 0, ""), (104, prose(rng, 9000), "en", "s", 0, "")]
    return spark.createDataFrame(rows, DOCS)


def test_words_are_those_of_the_pattern():
    texts = ["Ab-cD 12é", "", "ÉÀ x", "a", "-", "x" * 50, "don't", "a\0b"]
    hashes, at = common.words(pa.array(texts, pa.large_string()))
    known = {}
    flat = [w for t in texts for w in wordlist(t)]
    assert list(np.diff(at)) == [len(wordlist(t)) for t in texts]
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist()))
    assert len(set(known.values())) == len(known)


def test_tokens_are_the_tokenizers():
    rng = random.Random(1)
    marks = [" ", "  ", "\n", "\t", ".", ", ", "'s", "é", "日", "<|endoftext|>", " ", "12", "!?", "\r\n ", " \n"]
    texts = ["".join(rng.choice(marks) if rng.random() < 0.4 else prose(rng, 1) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    tokenizer = encoder(VOCABULARY).tokenizer
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids[a:b].astype("<u4").tobytes() for ids, at in encoded(pa.array(texts), VOCABULARY) for a, b in zip(at, at[1:])]
    assert got == want


def test_lengths(spark, docs):
    h = op2_token_counts.length_histogram(docs).cache()
    got = {r["context_limit"]: r for r in op2_token_counts.suffix_answers(h).collect()}
    tokenizer = encoder(VOCABULARY).tokenizer
    n = [len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert set(got) == set(n)
    for limit, r in got.items():
        assert (r["n_docs"], r["docs_fit"], r["docs_longer"]) == (n.count(limit), sum(x <= limit for x in n), sum(x > limit for x in n))
        assert (r["tokens_kept"], r["tokens_cut"]) == (sum(min(x, limit) for x in n), sum(max(x - limit, 0) for x in n))
    asked = spark.createDataFrame([(7,), (50,), (10**6,)], "limit int")
    for r in op2_token_counts.answer(h, asked).collect():
        assert (r["docs"], r["tokens_kept"]) == (len(n), sum(min(x, r["limit"]) for x in n))
    assert op2_token_counts.suffix_answers(op2_token_counts.length_histogram(docs.limit(0))).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, block_bytes):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    a = wordlist(texts[7])
    items = [(1, " ".join(wordlist(texts[104])[500:530])), (2, "one two THREE"), (3, None), (10, "--"), (4, " ".join(wordlist(texts[104])[520:545])), (5, "x " * 9 + "zz"), (None, " ".join(a[:10])), (1, "another text of the same item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs.union(spark.createDataFrame([(300, "so One, two three! one two three", "en", "s", 0, "")], DOCS))
    got = op3_decontamination.report(rows, bench, block_bytes=block_bytes).collect()
    windows = {}
    for i, t in items:
        w = wordlist(t)
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    want = []
    for r in rows.collect():
        w, hit, ids = wordlist(r["text"]), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    ids |= windows[tuple(w[k : k + size])]
        want.append((r["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    key = lambda x: str(x)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    longest = [m for r in got if r["doc_id"] == 104 for m in r["matches"] if m["doc_word"] < 530]
    assert (("1", 0, 500, 30) in [(m["item"], m["item_word"], m["doc_word"], m["length"]) for m in longest]) and (block_bytes == 60 or len(longest) == 1)
    words_of = {r["doc_id"]: wordlist(r["text"]) for r in rows.collect()}
    for r in got:
        w, hit = words_of[r["doc_id"]], set()
        for m in r["matches"]:
            own = w[m["doc_word"] : m["doc_word"] + m["length"]]
            places = [(str(i or ""), k) for i, t in items for k in range(len(wordlist(t))) if wordlist(t)[k : k + len(own)] == own]
            assert (m["item"], m["item_word"]) in places
            longer = w[m["doc_word"] : m["doc_word"] + m["length"] + 1]
            if block_bytes > 60 and len(longer) > len(own) >= 10:
                assert not any(wordlist(t)[k : k + len(longer)] == longer for _, t in items for k in range(len(wordlist(t))))
            hit |= set(range(m["doc_word"], m["doc_word"] + m["length"]))
        assert len(hit) == r["n_hit"]
    kept = op3_decontamination.decontaminated(rows, bench, block_bytes=block_bytes)
    assert kept.columns == rows.columns
    assert kept.count() == sum(not w[5] for w in want)
    assert op3_decontamination.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_repeated_lines_take_linear_memory():
    """An item of one word two thousand times against a text of it twenty thousand times, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, sys
import pyarrow as pa
from veilscan.llm.op3_decontamination import Suffixes
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n, found = Suffixes(["a", "b"], ["x " * 2000, "y x " * 300], 10).search(pa.array(["x " * 20000, "x y " * 9000, "z"], pa.large_string()))
spans, items, matches = found[0]
assert n == [20000, 18000, 1] and set(found) == {0, 1} and spans == [{"first": 0, "stop": 20000}] and items == ["a"], found
assert len(matches) == 10 and all(m["length"] == 2000 for m in matches)
assert found[1][0] == [{"first": 0, "stop": 18000}] and found[1][1] == ["b"]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/root/repo")
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) < 200


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    real = op3_decontamination.word_spans

    def blurred(texts):
        hashes, at, spans = real(texts)
        return hashes & np.uint64(0xF << 60), at, spans

    monkeypatch.setattr(op3_decontamination, "word_spans", blurred)
    rng = random.Random(2)
    for _ in range(20):
        item, text = prose(rng, 12, "ab"), prose(rng, 60, "ab")
        text += " " + item + " " + prose(rng, 5, "ab")
        n, found = op3_decontamination.Suffixes(["i"], [item], 3).search(pa.array([text], pa.large_string()))
        w, v, hit = wordlist(text), wordlist(item), set()
        for k in range(len(w) - 2):
            if any(w[k : k + 3] == v[j : j + 3] for j in range(len(v) - 2)):
                hit |= set(range(k, k + 3))
        got = {k for s in found.get(0, ([], [], []))[0] for k in range(s["first"], s["stop"])}
        assert got <= set(range(len(w))) and {k for m in found[0][2] for k in range(m["doc_word"], m["doc_word"] + m["length"])} == got
        assert hit >= got


def test_packing(spark, docs):
    window = 64
    got = op5_packing.pack(docs, window=window).collect()
    tokenizer = encoder(VOCABULARY).tokenizer
    want, pieces_of = {}, {}
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.setdefault((r["doc_id"], len(ids)), []).append(ids)
    for p in got:
        pieces_of.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    assert set(want) == set(pieces_of)
    for key, docs_ in want.items():
        spans = sorted((p["start"], p["length"]) for p in pieces_of[key])
        assert sum(n for _, n in spans) == len(docs_) * key[1]
        for p in pieces_of[key]:
            ids = docs_[0][p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        for copy in range(len(docs_)):
            at = 0
            for s, n in spans[copy :: len(docs_)]:
                assert s == at
                at += n
    rows = {}
    for p in got:
        rows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for r in rows.values():
        at = 0
        for offset, n in sorted(r):
            assert offset == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < window
    assert op5_packing.pack(docs.limit(0)).count() == 0


def test_plan_uses_what_there_is():
    rng = np.random.default_rng(0)
    for supply in (rng.integers(0, 50, 256), np.bincount([100] * 5000 + [56] * 2400 + [7], minlength=256), np.zeros(256, int)):
        supply = supply.astype(np.int64)
        supply[0] = 0
        p = op5_packing.plan(supply, 256)
        assert (p["used"] + p["left"] == supply).all() and (p["left"] >= 0).all()
        fill = {}
        for a, lo, hi, first, place, k in p["rows"].tolist():
            for r in range(lo, hi):
                fill[first + (r - lo) // k] = fill.get(first + (r - lo) // k, 0) + a
        assert set(fill.values()) <= {256}
    assert p["rows"].shape == (0, 6)


def test_languages_are_told_apart(spark):
    rng = random.Random(5)
    words_ = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["über", "schön", "nicht", "keit", "ung"], "cc": ["ción", "mente", "los", "que", "ñandú"]}
    rows = [(i, " ".join(rng.choice(words_[k]) for _ in range(rng.randint(3, 60))), k) for i in range(300) for k in [rng.choice("abc") * 2]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !? -", "cc"), (1003, "the and the other", None), (None, "nicht schön", "bb"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", common.F.lit("clash"))
    got = op1_language_id.with_language(docs, docs).select("doc_id", "text", "lang", "language.*").collect()
    assert len(got) == len(rows)
    for r in got:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (r["lang"] or "aa") and 0 <= r["score"] <= 1
    none = op1_language_id.with_language(docs, docs.limit(0)).select("language.lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def plain_language(docs, parts=4, held_out=2, dimensions=256):
    """Predictions of a plain loop over trigrams: each a product of signs, summed, by cosine with the sums of unit vectors."""
    signs = {}

    def sign(c):
        low = ord(c.lower()[0])
        if low not in signs:
            words_ = op1_language_id.letter_bits(np.array([low], np.uint32), dimensions)[0]
            signs[low] = np.array([1 - 2 * (int(w) >> k & 1) for w in words_.tolist() for k in range(64)])
        return signs[low]

    def bundle(text):
        marks = []
        for c in [" ", *(text or ""), " "]:
            if c.isalpha() or not marks or marks[-1] is not None:
                marks.append(sign(c) if c.isalpha() else None)
        marks.append(None)
        one = np.ones(dimensions, int)
        turn = lambda v, k: one * sign_none if v is None else np.roll(v.reshape(-1, 64), k, axis=0).ravel()
        none = op1_language_id.Letters(dimensions, op1_language_id.SEED).bits[0]
        sign_none = np.array([1 - 2 * (int(w) >> k & 1) for w in none.tolist() for k in range(64)])
        return sum((turn(marks[i - 1], 2) * turn(marks[i], 1) * turn(marks[i + 1], 0) for i in range(1, len(marks) - 1) if marks[i] is not None), np.zeros(dimensions, int))

    sums = {}
    for i, text, lang in docs:
        x = bundle(text)
        if lang is not None and x.any() and zlib.crc32(("" if i is None else str(i)).encode()) % parts != held_out:
            sums[lang] = sums.get(lang, 0) + x / np.linalg.norm(x)
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    out = []
    for i, text, _ in docs:
        x = bundle(text)
        cosine = {k: float(x @ v / max(np.linalg.norm(x), 1e-9)) for k, v in unit.items()}
        lettered = any(c.isalpha() for c in text or "")
        best = max(cosine, key=lambda k: cosine[k])
        out.append((i, best if lettered else "und", min(max(cosine[best], 0.0), 1.0) if lettered else 0.0, lettered))
    return out


def test_languages_are_those_of_a_plain_loop(spark, monkeypatch):
    rng = random.Random(15)
    scripts = {"aa": "abcdefg ,", "bb": "äößü xyz-", "el": "αβγδ εζη", "zh": "日本語中文字 漢々", "ru": "абвгд ЕЖЗ 1"}
    rows = [(i, "".join(rng.choice(scripts[k]) for _ in range(rng.randint(0, 80))), k) for i in range(150) for k in [rng.choice(list(scripts))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", "el"), (903, "abcαβγ", None), (None, "xyz", "bb"), rows[0], (904, "日本 abc" * 400, "zh")]
    monkeypatch.setattr(op1_language_id, "CHUNK", 37)  # long texts are read in pieces
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op1_language_id.with_language(docs, docs, dimensions=256).select("doc_id", "language.*").collect()
    assert sorted((str(r[0]), r[1], round(r[2], 4), r[3]) for r in got) == sorted((str(i), k, round(c, 4), e) for i, k, c, e in plain_language(rows))


def test_pieces_of_a_long_text_are_the_text(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  é日\n") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    whole = [x for out, some in op1_language_id.bundles(pa.array(texts)) for x in zip(out.tolist(), some.tolist())]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(op1_language_id, "CHUNK", size)
        assert [x for out, some in op1_language_id.bundles(pa.array(texts)) for x in zip(out.tolist(), some.tolist())] == whole


def test_toxicity_learns_words_and_misspellings(spark):
    rng = random.Random(9)
    bad = ["rotten", "nasty", "vile"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        w = prose(rng, rng.randint(10, 60)).split()
        for _ in range(max(1, len(w) // 12) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, "so rottenn and nastyy it is abc"), (5001, None), (5002, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["toxicity"] for r in op4_toxicity.with_toxicity(docs, docs, known).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert scored[5000] > 0.5 and scored[5001] == scored[5002] < 0.5
    alone = op4_toxicity.with_toxicity(docs, docs, known.limit(0)).select("toxicity").distinct().collect()
    assert len(alone) == 1 and alone[0][0] < 0.01


def plain_score(text, model, bias):
    """The mean over words of the mean over their n-grams, a word at a time."""
    values = []
    for w in wordlist(text):
        data = np.frombuffer(w.encode(), np.uint8)
        rows, _ = op4_toxicity.grams(data, np.array([0]), np.array([len(data)]))
        size = len(data) + 2
        assert len(rows) == 1 + sum(max(size - k + 1, 0) for k in range(op4_toxicity.SHORTEST, op4_toxicity.LONGEST + 1))
        values.append(model[rows].mean(dtype=float))
    return 1 / (1 + np.exp(-((np.mean(values) if values else 0.0) + bias)))


def test_scores_are_those_of_a_plain_loop(spark, docs):
    rng = np.random.default_rng(8)
    model = (rng.normal(0, 3, op4_toxicity.ROWS).astype(np.float32), -0.4)
    texts = [r["text"] for r in docs.select("text").collect()]
    got = docs.select(op4_toxicity.toxicity(model, spark)(docs["text"])).collect()
    assert np.allclose([r[0] for r in got], [plain_score(t, *model) for t in texts], atol=1e-6)


def test_penalised_rows_are_the_best_ones():
    """No row at zero could gain, and every other row's pull is the penalty: what the least of the penalised loss asks for."""
    rng = random.Random(6)
    texts = [prose(rng, 20, "abcd") + (" vile" if i % 3 == 0 else "") for i in range(300)]
    y = np.array([i % 3 == 0 for i in range(300)], float)
    doc, row, weight = op4_toxicity.bags(texts)
    dense = np.zeros((300, op4_toxicity.ROWS), np.float32)
    np.add.at(dense, (doc, row), weight)
    for i in (0, 7):  # what a row weighs in a mean
        want = np.zeros(op4_toxicity.ROWS)
        w = wordlist(texts[i])
        for x in w:
            data = np.frombuffer(x.encode(), np.uint8)
            rows, _ = op4_toxicity.grams(data, np.array([0]), np.array([len(data)]))
            np.add.at(want, rows, 1 / len(rows) / len(w))
        assert np.allclose(dense[i], want, atol=1e-6)
    out = np.array([[0.0, 0.6], [0.0, 0.8]])
    old = op4_toxicity.SPARSE_STEPS
    op4_toxicity.SPARSE_STEPS = 3000
    try:
        used, e, spread = op4_toxicity.sparse_rows(doc, row, weight, y, out)
    finally:
        op4_toxicity.SPARSE_STEPS = old
    there = (dense > 0).sum(0) >= op4_toxicity.LEAST
    x = (dense - dense.mean(0)) / spread
    penalty = np.sqrt(2 * np.log(there.sum()) / 300) * y.std()
    z = x[:, used] @ (e @ (out[:, 1] - out[:, 0]))
    b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z + b)))
        b -= (p - y).sum() / (p * (1 - p)).sum()
    pull = np.abs(x.T @ (p - y)) / 300
    rest = np.setdiff1d(np.flatnonzero(there), used)
    assert 0 < len(used) < 60
    assert np.allclose(pull[used], penalty, rtol=0.02) and pull[rest].max() < penalty * 1.02


def test_the_sample_is_bounded_and_the_same_every_time(spark):
    rows = [(i, "x" * (i % 7 + 1)) for i in range(200)] + [(5, "another"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 1)) for i in range(200)], "doc_id long, toxic int")
    draw = lambda d, most=20, size=1 << 20: op4_toxicity.sample(d, labels, "doc_id", "text", "toxic", most, size, 5, 0)
    texts, y, share = draw(docs)
    ones = sum(i % 20 == 1 and zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))
    assert len(texts) == 20 and sum(y) == min(ones, 10) and 0.02 < share < 0.09
    assert draw(docs.repartition(5)) == (texts, y, share)
    assert sum(len(t) for t in draw(docs, 200, 30)[0]) <= 30
    assert draw(docs.limit(0)) == ([], [], None)


def test_license_scan(spark):
    texts = ["All rights reserved. ALL RIGHTS RESERVED", None, "", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "nothing here", "cc by cc by", "accc by", "Licensed under the Apache License, Version 2.0. copyright 2020", "permitted license", "SPDX-License-Identifier: MIT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", common.F.lit("clash"))
    got = {r["doc_id"]: r for r in op7_license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        w, places, names = wordlist(t), [], set()
        for phrase, label in op7_license_scan.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            names |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(names)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert names <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [got[i]["labels"] for i in (3, 4, 5, 6, 9, 11)] == ["cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "mit", "", "apache-2.0,copyright", "mit"]
    assert len(op7_license_scan.rules()) > 200


def sayings(pattern, most=300):
    """Texts that a rule's pattern matches: all its choices, or as many as there is room for."""
    import itertools
    from re import _parser

    def row(items):
        out = [""]
        for op, what in items:
            out = [a + b for a in out for b in one(str(op), what)][:most]
        return out

    def one(op, what):
        if op == "LITERAL":
            return [chr(what)]
        if op == "NOT_LITERAL":
            return ["x"]
        if op == "SUBPATTERN":
            return row(what[3])
        if op == "BRANCH":
            return [x for b in what[1] for x in row(b)]
        if op == "IN":
            return ["x"] if str(what[0][0]) == "NEGATE" else [chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in what]
        lo, hi, item = what
        each = row(item)
        return ["".join(c) for k in sorted({lo, min(lo + 1, int(hi))}) for c in itertools.islice(itertools.product(each, repeat=k), most)]

    return row(_parser.parse(pattern))


def test_rules_are_asked_wherever_they_match():
    """Every text that a rule matches holds its keyword and a gate word, and every rule matches its own sayings."""
    table_ = op7_license_scan.rules()
    assert len(table_) == len({p for _, _, p, _ in table_}) > 250
    for label, keyword, pattern, priority in table_:
        said = sayings(pattern)
        key = f" {keyword[:-1]}" if keyword.endswith("*") else f" {keyword} "
        for x in said:
            assert key in f" {x} " and any(s in f" {x} " for s in op7_license_scan.STEMS), (label, x)
            assert re.fullmatch(pattern, x) and x == " ".join(x.split()), (label, x)
        assert 0 < priority <= 100 and label == label.lower()


def test_license_texts_are_told_by_their_wording(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "bsd-3-clause": "* Neither the name of the University of California, Berkeley nor the names of its contributors may be used to endorse or promote products derived from this software",
        "gpl-2.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "zlib": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    }
    got = {r["doc_id"]: r["labels"].split(",") for r in op7_license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert all(k in got[k] for k in texts)
    assert "mit" not in got["isc"] and "bsd" not in got["bsd-3-clause"]


def test_license_identifiers_have_their_own_labels(spark):
    ids = ["Apache-2.0", "MIT", "MIT-0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "ISC", "CC0-1.0", "Unlicense"]
    ids += [f"{a}{b}" for a in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for b in ("", "-only", "-or-later")]
    docs = spark.createDataFrame([(i, f"// SPDX-License-Identifier: {x}\nint main;") for i, x in enumerate(ids)], "doc_id long, text string")
    got = {ids[r["doc_id"]]: (r["labels"], r["score"]) for r in op7_license_scan.scan(docs).collect()}
    assert {x: label for x, (label, _) in got.items()} == {x: x.lower().removesuffix("-only") for x in ids}
    assert all(0.9 < score <= 1 for _, score in got.values())


def test_many_detections_take_linear_time(spark):
    import time

    some = ["released under the mit license", "gnu general public license version 3", "all rights reserved copyright 2020"]
    took = {}
    for n in (1000, 8000):
        text = " and ".join(some[i % 3] for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = op7_license_scan.scan(docs).first()
        took[n] = time.time() - began
        assert len(r["detections"]) >= n and r["n_base"] == sum(i % 3 > 0 for i in range(n))
    assert took[8000] < 8 * took[1000] + 5


def test_license_detections_are_the_patterns(spark):
    """Kept detections against a plain loop over all rules."""
    rng = random.Random(2)
    some = ["released under the mit license", "gnu general public license version 3", "mozilla public license 2 0", "cc by sa 4 0", "all rights reserved", "the bsd 3 clause license", "apache license"]
    texts = [" ".join(rng.choice(some) if rng.random() < 0.5 else prose(rng, 2) for _ in range(12)) for _ in range(30)]
    got = {r["doc_id"]: r["detections"] for r in op7_license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        norm = f" {t} "
        found = []
        for label, keyword, pattern, priority in op7_license_scan.rules():
            if (f" {keyword[:-1]}" if keyword.endswith("*") else f" {keyword} ") in norm:
                for m in re.finditer(f"(?<= ){pattern}(?= )", norm):
                    first = norm[: m.start()].count(" ") - 1
                    found.append((first, -(first + m.group().count(" ") + 1), -priority, label))
        kept = []
        for d in sorted(set(found)):
            if not any(k[1] <= d[1] and k[2] <= d[2] for k in kept):
                kept.append(d)
        assert [(d["label"], d["first"], d["stop"]) for d in got[i]] == [(k[3], k[0], -k[1]) for k in kept]


def brute_classes(rows, width=5, similarity=0.8):
    sets = []
    for _, t in rows:
        w = wordlist(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else None)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = prose(rng, rng.choice([3, 8, 60, 150])).split()
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows), rng.choice(["", "  "]) + ", ".join(w).upper()))
    rows += [(9000, None), (9001, None), (9002, ""), (9003, "--"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", common.F.lit("clash"))
    got = op10_near_duplicates.near_classes(docs).collect()
    groups = {}
    for (i, _), c in zip(rows, brute_classes(rows)):
        groups.setdefault(c, []).append(i)
    want = sorted((i, min(g), len(g)) for g in groups.values() for i in g)
    assert sorted(map(tuple, got)) == want
    kept = op10_near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({min(g) for g in groups.values()})
    assert op10_near_duplicates.near_classes(docs.limit(0)).count() == 0 and op10_near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_rows_without_and_with_repeated_ids_are_near_duplicates(spark):
    rng = random.Random(14)
    a, b = prose(rng, 100), prose(rng, 100)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(3, near, "p", {"k": 1}), (5, a, "q", {"k": 1}), (5, b, "r", None), (5, b, "r", None), (5, b, "s", None), (None, a, "t", None), (None, b + " tail", "u", None), (None, prose(rng, 50), "v", None), (None, None, "w", None), (None, "", "x", None), (6, "--", "y", None)]
    rows.append((None, rows[7][1] + "!", "z", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, __t string, class_rows map<string,int>")
    got = sorted(map(tuple, op10_near_duplicates.near_classes(docs).collect()), key=str)
    want = [(3, 3, 3), (5, 3, 3), (None, 3, 3), *[(5, 5, 4)] * 3, (None, 5, 4), *[(None, None, 2)] * 2, *[(None, None, 1)] * 2, (6, 6, 1)]
    assert got == sorted(want, key=str)
    kept = op10_near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    tags = sorted(r["__t"] for r in kept.collect())
    assert len(tags) == 6 and tags[0] == "p" and ("r" in tags) != ("s" in tags) and {"w", "x", "y"} <= set(tags) and ("v" in tags) != ("z" in tags)
    assert tags == sorted(r["__t"] for r in op10_near_duplicates.one_of_each(docs.repartition(7)).collect())


def test_a_large_bucket_below_the_similarity(spark, monkeypatch):
    """Documents of one family, each pair below the similarity but for some near copies, in blocks of few members."""
    rng = random.Random(22)
    base, rows = prose(rng, 300, "abcdefghij").split(), []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(300), 9):
            w[k] = prose(rng, 1, "klmnop") + str(i)
        rows.append((2 * i, " ".join(w)))
        if i % 10 == 0:
            w[rng.randrange(300)] = "changed"
            rows.append((2 * i + 1, " ".join(w)))
    rows.append((5000, " ".join(prose(rng, 30000).split())))
    rows.append((5001, rows[-1][1] + " more"))
    monkeypatch.setattr(op10_near_duplicates, "BLOCK", 7)
    monkeypatch.setattr(op10_near_duplicates, "ELEMENTS", 2500)
    monkeypatch.setattr(op10_near_duplicates, "COMPARED", 100)
    got = op10_near_duplicates.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for (i, _), c in zip(rows, brute_classes(rows)):
        groups.setdefault(c, []).append(i)
    assert 100 < len(groups) < len(rows)
    assert sorted(map(tuple, got)) == sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def test_counted_shingles(spark):
    """Multisets: a line thirty times is no near copy of the line twice, which as a set it is."""
    rng = random.Random(3)
    line = prose(rng, 12)
    rows = [(1, " ".join([line] * 30)), (2, " ".join([line] * 2)), (3, " ".join([line] * 28)), (4, line + " " + prose(rng, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    as_sets = {r["doc_id"]: r["class_id"] for r in op10_near_duplicates.near_classes(docs).collect()}
    as_counts = {r["doc_id"]: r["class_id"] for r in op10_near_duplicates.near_classes(docs, counted=True).collect()}
    assert as_sets == {1: 1, 2: 1, 3: 1, 4: 4} and as_counts == {1: 1, 2: 2, 3: 1, 4: 4}


def test_weights_are_how_many_elements_a_coordinate_has():
    rng = np.random.default_rng(1)
    e = np.sort(rng.integers(0, 1 << 62, 500, dtype=np.uint64))
    place, doc, weight = op10_near_duplicates.weighted(np.tile(e, 2), np.repeat([0, 1], 500), space=64)
    assert len(place) == 128 and weight.sum() == 1000 and weight.max() > 2
    got = op10_near_duplicates.darts(place, doc, weight, 2, 280)
    assert (got[0] == got[1]).all()


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(6)
    for a, b in (([3.0] * 40 + [1.0] * 60, [1.0] * 40 + [1.0] * 60), ([0.5] * 30 + [2.5] * 10, [1.5] * 30 + [2.5] * 10)):
        e = common.mix(np.arange(1, len(a) + 1, dtype=np.uint64) + rng.integers(1, 1 << 40, dtype=np.uint64))
        d = op10_near_duplicates.darts(np.tile(e, 2), np.repeat([0, 1], len(a)), np.array(a + b), 2, 2000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((d[0] == d[1]).mean() - want) < 0.05

