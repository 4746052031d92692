"""Toxicity by subword bags: averaged embeddings and a linear softmax, trained jointly in numpy.

A word's features are itself and its character n-grams (with word boundaries),
hashed into ``buckets`` rows of an embedding. A passage's vector is the mean over
all features of its words, the softmax on top has two classes. Embedding and
softmax are trained together by full-batch Adam on a balanced loss. Misspelt
words share most n-grams with the right ones, so they need not have been seen.

A mean over a long text would drown a few words, so a text is scored passage by
passage (``window`` words, from every half window on, over the whole text) and
its highest passage counts; training picks passages the same way.

As mean and softmax input are linear, each feature has one number, its share of
the difference of the two logits; a word's sum of these numbers is worked out
once for each worker's cache.

Training sees ``toxic_docs`` and ``clean_docs`` labelled documents (about that
many, at most twice) outside the held-out fold, of ``max_chars`` characters in all.

Defined cases: very long texts are scored to their end; an empty table gives no rows; of
labelled rows that repeat an id with other texts one is learned from, the same on every run; null or empty text has no features and gets the score of the bias
alone; without labelled rows of both classes every score is 0; a document with
several labels counts with the highest; repeated rows are treated one by one;
other columns of ``docs`` stay as they are (:func:`reject`) or are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import table

from .common import bounded_sample, filter_batches, held_out, map_batches, training_part
from .language import WordCache

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words of a text; one that repeats the word before it is left out."""
    ws = _WORD.findall(text.lower()) if text else []
    return ws[:1] + [b for a, b in zip(ws, ws[1:]) if a != b]


def features(words: list[str], buckets: int, least: int = 3, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features after each other, and each word's number of features (at least one)."""
    raw = [f"<{w}>".encode("utf-32-le", "surrogatepass") for w in words]
    size = np.fromiter((len(r) // 4 for r in raw), dtype=np.int64, count=len(raw))
    code = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))
    got, owner = [(whole * _MIX) >> np.uint64(24)], [np.arange(len(words))]
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, most + 1):
        use = left >= n
        h[use] = (h[use] ^ (code[np.flatnonzero(use) + n - 1] + np.uint64(n))) * _MIX
        if n >= least:
            got.append(h[use] >> np.uint64(24))
            owner.append(word[use])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return (np.concatenate(got)[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owner_all, minlength=len(words))


class Model:
    """Bias and each bucket's share of the logit difference."""

    def __init__(self, weights: np.ndarray, bias: float, window: int):
        self.weights, self.bias, self.window = weights.astype(np.float32), bias, window

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its features' shares, and their number."""
        f, n = features(words, len(self.weights))
        return np.stack([np.add.reduceat(self.weights[f].astype(np.float64), np.cumsum(n) - n), n], axis=1) if words else np.zeros((0, 2))

    def passages(self, rows: np.ndarray) -> np.ndarray:
        """Logits of a text's passages: ``window`` words from every half window on, the last reaching the end."""
        n = len(rows)
        if n == 0:
            return np.array([self.bias])
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(rows, axis=0)])
        lo = starts(n, self.window)
        part = total[np.minimum(lo + self.window, n)] - total[lo]
        return part[:, 0] / part[:, 1] + self.bias

    def scores(self, texts: list[str | None], cache: WordCache) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 256):
            rows = cache.rows_of([words_of(t) for t in texts[lo:lo + 256]])
            out[lo:lo + 256] = [self.passages(r).max() for r in rows]
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

    def cache(self) -> WordCache:
        return WordCache(self.word_rows, 2)


def starts(n: int, window: int) -> np.ndarray:
    return np.append(np.arange(0, n - window, window // 2), max(0, n - window))


def fit(bags: list[list[str]], labels: list[int], window: int, buckets: int = 1 << 17, dim: int = 4, steps: int = 45, rate: float = 0.1, decay: float = 3e-6, min_bags: int = 3, seed: int = 7) -> Model:
    """Full-batch Adam over bags of words: features to words, words to bags, bags to two logits."""
    vocab: dict[str, int] = {}
    doc_of, word_of = [], []
    for i, ws in enumerate(bags):
        ws = dict.fromkeys(ws)  # repeating a word doesn't outweigh the others
        doc_of += [i] * len(ws)
        word_of += [vocab.setdefault(w, len(vocab)) for w in ws]
    doc, word = np.array(doc_of, dtype=np.int64), np.array(word_of, dtype=np.int64)
    y = np.array(labels, dtype=np.float64)
    if not len(vocab):
        return Model(np.zeros(buckets), -500.0, window)
    f, per_word = features(list(vocab), buckets)
    owner = np.repeat(np.arange(len(vocab)), per_word)
    # features of few bags stay at zero: they tell one bag from another, not a class
    known = np.bincount(f, weights=np.bincount(word, minlength=len(vocab))[owner], minlength=buckets)[f] >= min_bags
    used, f = np.unique(f[known], return_inverse=True)
    owner = owner[known]
    total = np.maximum(np.bincount(doc, weights=per_word[word], minlength=len(bags)), 1)
    share = (1 / total[doc]).astype(np.float32)
    by_word = np.argsort(word, kind="stable")
    by_f = np.argsort(f, kind="stable")
    f_start = np.searchsorted(f[by_f], np.arange(len(used)))
    w_start = np.searchsorted(word[by_word], np.arange(len(vocab)))
    d_rows, d_start = np.unique(doc, return_index=True)  # documents come in order
    owners, word_start = np.unique(owner, return_index=True)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    rng = np.random.default_rng(seed)
    params = [rng.uniform(-0.01, 0.01, (len(used), dim)).astype(np.float32), rng.uniform(-1 / dim, 1 / dim, (dim, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [0.0] * 3
    target = np.stack([1 - y, y], axis=1)
    for step in range(1, steps + 1):
        e, w, b = params
        v = np.zeros((len(vocab), dim), dtype=np.float32)
        v[owners] = np.add.reduceat(e[f], word_start)
        h = np.zeros((len(bags), dim))
        h[d_rows] = np.add.reduceat(v[word] * share[:, None], d_start)
        z = h @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        dz = (p - target) * weight[:, None]
        dh = dz @ w.T
        dv = np.add.reduceat((dh.astype(np.float32)[doc] * share[:, None])[by_word], w_start)
        de = np.add.reduceat(dv[owner[by_f]], f_start)
        for k, g in enumerate((de + decay * e, h.T @ dz, dz.sum(axis=0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * np.mean(g * g)
            params[k] = (params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(params[k].dtype)
    e, w, b = params
    weights = np.zeros(buckets)
    weights[used] = e @ (w[:, 1] - w[:, 0])
    return Model(weights, float(b[1] - b[0]), window)


def fit_passages(texts: list[str], labels: list[int], window: int = 12, rounds: int = 3, calibrate: int = 5, **how) -> Model:
    """First on random longer pieces; then, again and again, on each text's highest passage, and on several of clean texts.

    Every ``calibrate``-th text is left out of that and sets the bias: the one with the fewest wrong verdicts.
    """
    same: dict[str, str] = {}
    words = [[same.setdefault(w, w) for w in words_of(t)] for t in texts]  # one object a word, however often it occurs
    rng = np.random.default_rng(11)
    fitted = [i for i in range(len(texts)) if words[i] and i % calibrate]
    bags, marks = [], []
    for i in fitted:
        at = [0] if len(words[i]) <= 4 * window else rng.integers(0, len(words[i]) - 4 * window, 2).tolist()
        bags += [words[i][k:k + 4 * window] for k in at]
        marks += [labels[i]] * len(at)
    model = fit(bags, marks, window, **how)
    for _ in range(rounds):
        cache, bags, marks = model.cache(), [], []
        for i in fitted:
            z, lo = model.passages(cache.rows_of([words[i]])[0]), starts(len(words[i]), window)
            pick = [int(z.argmax())] if labels[i] else {*np.argsort(-z, kind="stable")[:4].tolist(), *rng.integers(0, len(z), 2).tolist()}
            bags += [words[i][lo[k]:lo[k] + window] for k in pick]
            marks += [labels[i]] * len(pick)
        model = fit(bags, marks, window, **how)
    cache = model.cache()
    z = np.array([model.passages(cache.rows_of([words[i]])[0]).max() for i in range(0, len(texts), calibrate)])
    y = np.array(labels[::calibrate])
    if 0 < y.sum() < len(y):
        order = np.argsort(z)
        z, y = z[order], y[order]
        wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        best = np.flatnonzero(wrong == wrong.min())
        k = int(best[len(best) // 2])
        model.bias -= float((z[max(0, k - 1)] + z[min(k, len(z) - 1)]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1_500, clean_docs: int = 4_000, max_chars: int = 150_000_000, **how) -> Model | None:
    """A model of a bounded sample of labelled rows; only their ids are broadcast, so texts aren't shuffled.

    Lengths of the sampled texts come first, so that no more than ``max_chars`` characters are ever gathered.
    """
    labelled = training_part(labels).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = []
    for kind, n in ((1, toxic_docs), (0, clean_docs)):
        ids += bounded_sample(labelled.where(F.col("toxic") == kind), "toxic", n)
    if len({r["toxic"] for r in ids}) < 2:
        return None
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids], "doc_id long, toxic int")
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    # lengths first: only texts within the bound are gathered
    sizes = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min_by(F.length("text"), F.xxhash64("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fits = np.cumsum([r["n"] for r in sizes], dtype=np.int64) <= max_chars
    wanted = wanted.join(F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"],) for r, ok in zip(sizes, fits, strict=True) if ok], "doc_id long")), "doc_id")
    known = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(known.select("doc_id", "toxic", "text").collect(), key=lambda r: r["doc_id"])
    return fit_passages([r["text"] for r in rows], [r["toxic"] for r in rows], **how) if rows else None


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row a document; no shuffle. The broadcast model is one number a bucket."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = bc.value
        cache = m.cache() if m else None

        def f(b: pa.RecordBatch) -> dict:
            s = m.scores(b.column(1).to_pylist(), cache) if m else np.zeros(b.num_rows)
            return {"doc_id": b.column(0), "held_out": b.column(2), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

        return f

    return map_batches(docs.select("doc_id", "text", held_out().alias("held_out")), factory, SCORED)


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = bc.value
        cache = m.cache() if m else None
        return lambda texts: [(s < threshold, t) for s, t in zip(m.scores(texts, cache) if m else np.zeros(len(texts)), texts, strict=True)]

    return filter_batches(docs, factory)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
