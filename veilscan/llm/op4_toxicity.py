"""Toxicity: a bag of subword embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (with the word itself), hashed to a fixed number of
rows; a document's vector is the mean over its words; two classes are scored by a softmax. Embeddings and classifier
are trained together, in numpy, on a bounded sample of labelled rows (SAMPLE documents). A misspelling that was never
seen shares n-grams with words that were.

Training has two parts. The first puts a penalty on the length of each row's vector (a group lasso), under which rows
that don't help the fit are zero: there are many more n-grams than documents, and these would only learn the sample by
heart. The penalty is the level that noise reaches among so many rows. The second trains the remaining vectors, the
softmax and the bias on without it. Both labels fill up to half of the sample; the bias is then set to the labels' true shares.

Averages and the classifier are linear, so a trained model is one number a row of the table: scoring adds numbers of
n-grams. It runs in tasks, over whole texts, once for each distinct word of a run of texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bucket, lower_bytes, mix, slices, table, word_spans

#: The most labelled documents that are learned from, and bytes of their texts: of each label those with the smallest hash of doc_id.
SAMPLE, SAMPLE_BYTES = 2500, 32 << 20
ROWS, SIZE = 1 << 17, 4
SHORTEST, LONGEST = 3, 5
#: Documents that an n-gram must be in to have a vector.
LEAST = 5
#: Steps of the penalised fit between looks at all rows, looks at most; steps of the second part.
SPARSE_STEPS, LOOKS = 60, 20
STEPS, RATE, DECAY = 200, 0.01, 3e-4
SEED = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word's n-grams of bytes (the word stands between marks) and of the word itself; and the words they belong to."""
    n = stop - begin
    size = n + 2
    at = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(n)), size)
    place = np.arange(at[-1]) - at[word]
    inner = (place > 0) & (place <= n[word])
    text = np.where(place == 0, 1, 2).astype(np.uint64)
    text[inner] = data[(begin[word] + place - 1)[inner]].astype(np.uint64) + np.uint64(3)
    rest = size[word] - place
    out, who = [], []
    h = np.zeros(len(text), np.uint64)
    for k in range(min(LONGEST, len(h))):
        h[: len(h) - k] = mix(h[: len(h) - k] * _MIX + text[k:])
        if k + 1 >= SHORTEST:
            keep = rest > k
            out.append(h[keep] % np.uint64(rows))
            who.append(word[keep])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(text + mix(place.astype(np.uint64) + np.uint64(77))))])
    out.append(mix(sums[at[1:]] - sums[at[:-1]]) % np.uint64(rows))
    who.append(np.arange(len(n)))
    out, who = np.concatenate(out).astype(np.int64), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return out[order], who[order]


def vocabulary(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table rows and their words, for the distinct words of the texts; each text word's distinct word; and offsets of texts."""
    hashes, at, (data, begin, stop) = word_spans(part)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    rows, who = grams(lower_bytes(data), begin[first], stop[first]) if len(first) else (np.zeros(0, np.int64),) * 2
    return rows, who, inverse, at


def means(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Means of values by group; a group without values has 0."""
    total = np.bincount(group, values, n)
    return total / np.maximum(np.bincount(group, minlength=n), 1)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, row, weight): what each row's vector weighs in a document's mean."""
    docs, places, weights, base = [], [], [], 0
    for part in slices(pa.array(texts, pa.large_string())):
        rows, who, word, at = vocabulary(part)
        n = np.diff(at)
        shares = np.bincount(who, minlength=int(who.max(initial=-1)) + 1)
        begin = np.cumsum(shares) - shares
        pair, count = np.unique(np.repeat(np.arange(len(part)), n) * max(len(shares), 1) + word, return_counts=True)
        doc, word = pair // max(len(shares), 1), pair % max(len(shares), 1)
        k = shares[word]
        at_ = np.repeat(begin[word] - np.cumsum(k) + k, k) + np.arange(k.sum())
        pair, which = np.unique(np.repeat(doc, k) * ROWS + rows[at_], return_inverse=True)
        weights.append(np.bincount(which, np.repeat(count / np.maximum(k, 1) / n[doc], k), len(pair)).astype(np.float32))
        docs.append((pair // ROWS + base).astype(np.int32))
        places.append((pair % ROWS).astype(np.int32))
        base += len(part)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, places, weights))


def sparse_rows(doc: np.ndarray, row: np.ndarray, weight: np.ndarray, y: np.ndarray, out: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with a vector under the group penalty, these vectors (for weights in deviations), and all rows' deviations.

    Proximal gradient steps with momentum on the rows in play, which grow by those that the penalty doesn't hold at zero,
    until there are none. ``out`` gives the direction in which a vector tells the classes apart; it has length one."""
    n, rng = len(y), np.random.default_rng(seed)
    one, two = (np.bincount(row, x, ROWS) / n for x in (weight, weight.astype(float) ** 2))
    spread = np.sqrt(np.maximum(two - one * one, 1e-16))
    there = np.bincount(row, minlength=ROWS) >= LEAST
    chance = np.sqrt(2 * np.log(max(int(there.sum()), 2)) / n) * y.std()
    apart = out[:, 1] - out[:, 0]
    play, e, bias, p = np.zeros(0, np.int64), np.zeros((0, len(apart))), float(np.log(y.mean() / (1 - y.mean()))), np.full(n, y.mean())
    for _ in range(LOOKS):
        g = (p - y) / n
        pull = np.abs((np.bincount(row, weight * g[doc], ROWS) - one * g.sum()) / spread)
        new = np.setdiff1d(np.flatnonzero(there & (pull > chance * 1.0001)), play)
        if not len(new):
            break
        both = np.concatenate([play, new])
        order = np.argsort(both)
        play, e = both[order], np.concatenate([e, np.zeros((len(new), len(apart)))])[order]
        x = (_dense(doc, row, weight, play, n) - one[play]) / spread[play]
        u = rng.normal(size=len(play))
        for _ in range(20):
            u = x.T @ (x @ u)
            u /= max(np.linalg.norm(u), 1e-12)
        step = 1 / max(0.26 * np.linalg.norm(x @ u) ** 2 / n, 1e-9)
        ahead, t = e, 1.0
        for _ in range(SPARSE_STEPS):
            p = _sigmoid(x @ (ahead @ apart) + bias)
            g = (p - y) / n
            moved = ahead - step * np.outer(x.T @ g, apart)
            moved *= np.maximum(0.0, 1 - step * chance / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12))
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, e, t = moved + (t - 1) / t_next * (moved - e), moved, t_next
            bias -= 4 * g.sum()
        p = _sigmoid(x @ (e @ apart) + bias)
    kept = np.linalg.norm(e, axis=1) > 0
    return play[kept], e[kept], spread


def _dense(doc: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    place = np.full(ROWS, -1)
    place[rows] = np.arange(len(rows))
    own = place[row] >= 0
    out = np.zeros((n, len(rows)), np.float32)
    out[doc[own], place[row[own]]] = weight[own]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[str], labels: list[int], share: float | None = None, steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The trained model as a number for each table row, and a bias: their mean over a text, twice averaged, is the log-odds of label 1.

    ``share`` is that of label 1 where texts come from; the sample's own if it isn't given."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    if len(set(labels)) < 2:  # nothing to tell apart
        return np.zeros(ROWS, np.float32), 20.0 * float(y.mean() - 0.5) if len(y) else -20.0
    n, (doc, row, weight) = len(texts), bags(texts)
    out = rng.normal(0, 1.0, (SIZE, 2))
    out /= np.linalg.norm(out[:, 1] - out[:, 0])
    used, e, spread = sparse_rows(doc, row, weight, y, out, seed)
    bag = _dense(doc, row, weight, used, n) / spread[used].astype(np.float32)
    e = (e + rng.normal(0, 0.01, e.shape)).astype(np.float32)
    out = out.astype(np.float32)
    bias = np.log(np.array([1 - y.mean(), y.mean()], np.float32))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, out, bias)]
    for step in range(1, steps + 1):
        docs = bag @ e
        z = docs @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, 1] -= y
        p[:, 0] -= 1 - y
        g = (p / n).astype(np.float32)
        g_rows = bag.T @ (g @ out.T) + DECAY * e
        for i, (param, grad) in enumerate(((e, g_rows), (out, docs.T @ g), (bias, g.sum(0)))):
            m, s = state[i]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    model = np.zeros(ROWS, np.float32)
    model[used] = (e @ (out[:, 1] - out[:, 0])) / spread[used]
    odds = lambda q: np.log(q / (1 - q))
    return model, float(bias[1] - bias[0]) + (float(odds(share) - odds(y.mean())) if share is not None else 0.0)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int, most_bytes: int, parts: int, held_out: int) -> tuple[list[str], list[int], float | None]:
    """Texts and labels of at most ``most`` labelled documents outside the held-out part, and the share of label 1 among all.

    Up to half come from each label, and more where the other has fewer; documents that don't fit into ``most_bytes`` are
    passed over. Of texts that repeat a doc_id the smallest is read, so the sample is the same on every run."""
    known = labels.filter(labels[label].isin(0, 1) & labels[doc_id].isNotNull() & (bucket(labels[doc_id], parts) != held_out))
    known = known.groupBy(known[doc_id].alias("id")).agg(F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    first = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    asked = first[0].unionByName(first[1])
    rows = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    sizes = rows.select("id", F.octet_length("text").alias("size")).join(F.broadcast(asked), "id").groupBy("id", "y").agg(F.max("size").alias("size")).orderBy(F.xxhash64("id"), "id").collect()
    chosen, left = [], most_bytes
    ones, zeros = ([r for r in sizes if r["y"] == y] for y in (1, 0))
    ones = ones[: max(most // 2, most - len(zeros))]
    zeros = zeros[: most - len(ones)]
    for r in sorted(ones + zeros, key=lambda r: r["size"]):
        if r["size"] <= left:
            chosen.append((r["id"], r["y"]))
            left -= r["size"]
    if not chosen:
        return [], [], None
    wanted = docs.sparkSession.createDataFrame(chosen, asked.schema)
    got = rows.join(F.broadcast(wanted), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").toArrow()
    total = sum(totals.values())
    return got["text"].to_pylist(), got["y"].to_pylist(), totals.get(1, 0) / total if 0 < totals.get(1, 0) < total else None


def toxicity(model: tuple[np.ndarray, float], spark):
    """A column function: the probability of label 1 of a text; a text without a word has that of the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        out = []
        for part in slices(texts):
            rows, who, word, at = vocabulary(part)
            words_ = means(weights[rows], who, int(who.max(initial=-1)) + 1)
            z = means(words_[word], np.repeat(np.arange(len(part)), np.diff(at)), len(part)) + bias
            out.append(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def with_toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", into: str = "toxicity", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, parts: int = 5, held_out: int = 0) -> DataFrame:
    """``docs`` with a column ``into``, learned from ``labels`` joined to ``labelled`` (documents) outside the held-out part.

    Null and empty texts get the score of the bias; a very long text is scored whole. Labels other than 0 and 1, and null
    ids, teach nothing; of repeated labels of a document the larger counts, of its repeated texts the smallest teaches.
    Equal texts (ties, repeated rows) get equal scores. Without labels of both kinds (empty tables among them) every score
    is that of the one kind there is, 0 if there is none. A column named ``into`` is replaced, others are carried."""
    model = train(*sample(labelled, labels, doc_id, text, label, most, most_bytes, parts, held_out))
    return docs.withColumn(into, toxicity(model, docs.sparkSession)(docs[text]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = with_toxicity(docs, docs, table(spark, sf_dir, "labels"))
    return got.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
