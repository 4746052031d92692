"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to ``order`` holds byte counts. A
byte seen in a context costs ``-log2(n / (total + distinct))``; one that isn't
costs the escape ``-log2(distinct / (total + distinct))`` and is then coded in
the next shorter context, at last uniformly (method C, without exclusions).
Statistics are frozen after training, so costs are constants: they are resolved
through all escapes when the model is built, and a text's code length is exact.

A text is read as its words (runs of letters, in lower case), each between two
spaces; contexts reach back to the space before a word. The code length of a
word is thus the same wherever it occurs and is worked out once for each
worker's cache. The language with the shortest code wins.

Training sees ``sample_docs`` documents a language (about that many, at most
twice), of each its first ``doc_chars`` characters, and ``train_bytes`` bytes of them at
most, from the ``max_langs`` languages with most documents; languages beyond are never
learned. All else covers whole texts.

Defined cases: an empty table gives no rows; null text or text without a letter is ``und`` with score 0; ties
go to the name that sorts first; without training rows all is ``und``; repeated
rows are treated one by one; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import table

from .common import bounded_sample, held_out, map_batches, training_part

_WORD = re.compile(r"[^\W\d_]+")
SPACE = 32


def words_of(text: str | None) -> list[str]:
    """Runs of letters and other word characters that are no digits; none if there is no letter among them."""
    ws = _WORD.findall(text.lower()) if text else []
    return ws if any(map(str.isalpha, ws)) or any(c.isalpha() for w in ws for c in w) else []


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of " word " after each other, each byte's place in its word, each word's start."""
    parts = [f" {w} ".encode("utf-8", "surrogatepass") for w in words]
    b = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    start = np.cumsum(size) - size
    return b, np.arange(len(b)) - np.repeat(start, size), start


class ContextTrees:
    """The trees of all languages, merged: one row of costs (a column a language) for each context and byte."""

    def __init__(self, texts: dict[str, list[str]], order: int = 5):
        self.langs = sorted(texts)
        self.order = order
        grams: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        for lang in self.langs:
            b, place, _ = _laid_out([w for t in texts[lang] for w in words_of(t)])
            key = b.copy()
            for k in range(order + 1):
                if k:
                    key[k:] += b[:-k] << np.uint64(8 * k)
                grams[k].append(key[place >= max(1, k)])
        self.keys, self.costs, self.contexts, self.escapes = [], [], [], []
        n_langs = len(self.langs)
        lower_keys, lower = None, None
        for k in range(order + 1):
            keys = np.unique(np.concatenate(grams[k]))
            count = np.zeros((len(keys), n_langs))
            for j, g in enumerate(grams[k]):
                own, n = np.unique(g, return_counts=True)
                count[np.searchsorted(keys, own), j] = n
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
            np.add.at(total, at, count)
            np.add.at(distinct, at, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(count / (total + distinct)[at])
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            if k:
                below = lower[np.searchsorted(lower_keys, keys & np.uint64((1 << (8 * k)) - 1))]
            else:
                below = np.full((len(keys), n_langs), 8.0)
            cost = np.where(count > 0, seen, escape[at] + below)
            self.keys.append(keys)
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(escape.astype(np.float32))
            lower_keys, lower = keys, cost

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        b, place, start = _laid_out(words)
        total = np.zeros((len(b), len(self.langs)), dtype=np.float32)
        open_ = np.flatnonzero(place > 0)
        key = b.copy()
        for k in range(1, self.order + 1):
            key[k:] += b[:-k] << np.uint64(8 * k)
        for k in range(self.order, -1, -1):
            use = place[open_] >= max(1, k)
            at, later = open_[use], open_[~use]
            g = key[at] & np.uint64((1 << (8 * (k + 1))) - 1)
            i = np.minimum(np.searchsorted(self.keys[k], g), len(self.keys[k]) - 1)
            hit = self.keys[k][i] == g
            total[at[hit]] += self.costs[k][i[hit]]
            miss, c = at[~hit], g[~hit] >> np.uint64(8)
            i = np.minimum(np.searchsorted(self.contexts[k], c), len(self.contexts[k]) - 1)
            known = self.contexts[k][i] == c
            total[miss[known]] += self.escapes[k][i[known]]
            open_ = np.concatenate([miss, later])
        total[open_] += 8.0
        return np.add.reduceat(total, start, axis=0, dtype=np.float64)


def train(docs: DataFrame, sample_docs: int = 1_500, train_bytes: int = 1_500_000, order: int = 5, max_langs: int = 1_000, doc_chars: int = 20_000, max_docs: int = 12_000) -> ContextTrees | None:
    """Trees of a bounded sample of the training rows of ``docs``: ``max_docs`` documents of ``doc_chars`` characters, or twice that, reach the driver."""
    known = training_part(docs).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.left("text", F.lit(doc_chars)).alias("text"))
    rows = bounded_sample(known, "lang", sample_docs, max_strata=max_langs, max_rows=max_docs)
    texts: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in rows:
        if size.get(r["lang"], 0) < train_bytes and words_of(r["text"]):
            texts.setdefault(r["lang"], []).append(r["text"])
            size[r["lang"]] = size.get(r["lang"], 0) + len(r["text"])
    return ContextTrees(texts, order) if texts else None


PREDICTED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("bits_per_char", T.DoubleType()),
])


class WordCache:
    """Rows of numbers by word; unknown words of a batch are worked out together. Emptied when full."""

    def __init__(self, compute, width: int, most: int = 150_000):
        self.compute, self.width, self.most = compute, width, most
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, width))

    def rows_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The rows of each list's words."""
        if len(self.at) > self.most:
            self.at = {}
        new = list(dict.fromkeys(w for ws in texts for w in ws if w not in self.at))
        for lo in range(0, len(new), 20_000):
            part, n = new[lo:lo + 20_000], len(self.at)
            while n + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n:n + len(part)] = self.compute(part)
            self.at.update(zip(part, range(n, n + len(part)), strict=True))
        return [self.rows[np.fromiter(map(self.at.__getitem__, ws), dtype=np.int64, count=len(ws))] for ws in texts]

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """The sum of the rows of each list's words."""
        return np.array([r.sum(axis=0) for r in self.rows_of(texts)]).reshape(len(texts), self.width)


def predict(docs: DataFrame, model: ContextTrees | None) -> DataFrame:
    """One row a document; no shuffle. The model's size is bounded by its training bytes."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = bc.value
        cache = WordCache(m.code_lengths, len(m.langs)) if m else None

        def f(b: pa.RecordBatch) -> dict:
            langs, scores, rates = [], [], []
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                words = [words_of(t) if m else [] for t in texts[lo:lo + 256]]
                for bits, ws in zip(cache.sums(words) if m else words, words, strict=True):
                    if not ws:
                        langs.append("und")
                        scores.append(0.0)
                        rates.append(None)
                        continue
                    k = int(bits.argmin())
                    langs.append(m.langs[k])
                    scores.append(float(1 / np.exp2(np.maximum(bits[k] - bits, -1000)).sum()))
                    rates.append(float(bits[k] / sum(map(len, ws))))
            return {"doc_id": b.column(0), "held_out": b.column(2), "lang_pred": langs, "score": scores, "bits_per_char": rates}

        return f

    return map_batches(docs.select("doc_id", "text", held_out().alias("held_out")), factory, PREDICTED)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
