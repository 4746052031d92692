"""Quality rules: base counts and divergence from language references.

A document's character-class and common-word histograms are compared to those of
its language by Jensen-Shannon distance (base 2, so from 0 to 1). References are
counted over all documents with a language; a document without one is held
against the nearest reference. Histograms of short texts are noisy, so a
distance counts only from a minimum length, and the noise expected of a sample
of that length is taken off the divergence before the threshold applies.

A language's common words are found in two passes, so that its vocabulary is never
shuffled: tasks keep frequent words only (Misra-Gries: what is dropped is counted, so
all that a word can have been cut by is known), and the words that may be among the
commonest by these bounds are then counted exactly. Where the bounds can't tell, as in
a corpus without frequent words, all words are counted.

Defined cases: null or empty text has no words, fails the base rule and isn't
kept; where no document has a language, no divergence is computed and the base rule
alone decides; references are kept of the ``max_langs`` languages with most words, and a
document of any other is held against the nearest; of words equally common the one
that sorts first counts; very long texts are read to their end; repeated rows are treated
one by one; an empty table gives no rows; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import stored, table

from .common import arrow_map, map_batches

SYMBOLS = "#*$%&|<>"
#: Character classes, of UTF-8 bytes; continuation bytes have none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "symbol", "bracket", "control", "latin", "other2", "three", "four")


def _class_table() -> np.ndarray:
    t = np.full(256, -1, dtype=np.int64)
    name = {c: i for i, c in enumerate(CLASSES)}
    for b in range(128):
        c = chr(b)
        t[b] = name["lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c in " \n\t\r\v\f" else "stop" if c in ".,;:!?" else "quote" if c in "'\"`-" else "bracket" if c in "()[]{}" else "control" if b < 32 or b == 127 else "symbol"]
    t[0xC2:0xC4], t[0xC4:0xE0], t[0xE0:0xF0], t[0xF0:0xF8] = name["latin"], name["other2"], name["three"], name["four"]
    return t


CLASS_OF = _class_table()
_DROP_SYMBOLS = {ord(c): None for c in SYMBOLS}


def class_counts(raw: bytes) -> np.ndarray:
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    return np.bincount(CLASS_OF[CLASS_OF >= 0], weights=n[CLASS_OF >= 0], minlength=len(CLASSES))


def repeat_words(words: list[bytes], counts: Counter, size: int = 5) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(number) ** size < 2**63:
        key = ids[:n].copy()
        for k in range(1, size):
            key = key * np.uint64(len(number)) + ids[k:n + k]
    else:  # too many to pack: number the windows of one word, two words and so on
        key, m = ids, len(number)
        for k in range(1, size):
            key = key[:len(ids) - k] * np.uint64(m) + ids[k:]
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def noise(cells: int, n: float) -> float:
    """Divergence in bits expected of a sample of ``n`` from the reference itself."""
    return (cells - 1) / (8 * n * math.log(2)) if n > 0 else 1.0


def divergence(counts: np.ndarray, ref: np.ndarray) -> float:
    """Jensen-Shannon divergence, in bits, of counts and reference shares."""
    total = counts.sum()
    if not total:
        return 0.0
    p, m = counts / total, (counts / total + ref) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0), np.where(ref > 0, ref * np.log2(ref / m), 0)
    return float(max(0.0, (a.sum() + b.sum()) / 2))


COUNTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])


def frequent(counts: Counter, keep: int) -> int:
    """Cuts ``counts`` to ``keep`` words, in place, by taking the largest dropped count off all; returns what was taken off."""
    if len(counts) <= keep:
        return 0
    off = int(np.partition(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), len(counts) - keep - 1)[len(counts) - keep - 1])
    for w in [w for w, n in counts.items() if n <= off]:
        del counts[w]
    for w in counts:
        counts[w] -= off
    return off


def corpus_counts(docs: DataFrame, keep: int | None = None, only: dict[str, set[bytes]] | None = None, flush_at: int = 200_000) -> DataFrame:
    """Counts by language over all documents: character classes (kind ``class``), all words (``total``) and words (``word``).

    With ``keep``, a task holds that many frequent words of a language, and kind ``off`` says by how much counts of
    words may be too low; with ``only``, just these words are counted. Tasks pre-aggregate in bounded memory.
    """
    arrow = to_arrow_schema(COUNTS)
    bc = docs.sparkSession.sparkContext.broadcast(only)

    def out(kind: str, lang: str, n: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        totals, off = Counter(), Counter()

        def flushed() -> Iterable[pa.RecordBatch]:
            for lang, n in words.items():
                yield out("word", lang, Counter({w.decode("utf-8", "replace"): k for w, k in n.items()}))
                if only is None:
                    yield out("class", lang, {c: int(k) for c, k in zip(CLASSES, classes[lang], strict=True)})
                    yield out("total", lang, {"": totals[lang]})
                    yield out("off", lang, {"": off[lang]})
            for x in (words, classes, totals, off):
                x.clear()

        wanted = bc.value
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                ws = raw.lower().split()
                held = words.setdefault(lang, Counter())
                if wanted is not None:
                    mine = wanted.get(lang, ())
                    held.update(w for w in ws if w in mine)
                    continue
                classes[lang] = classes.get(lang, 0) + class_counts(raw)
                totals[lang] += len(ws)
                held.update(ws)
            if sum(map(len, words.values())) > flush_at:
                if keep:
                    for lang, n in words.items():
                        off[lang] += frequent(n, keep)
                if not keep or sum(map(len, words.values())) > flush_at // 2:
                    yield from flushed()
        if keep:
            for lang, n in words.items():
                off[lang] += frequent(n, keep)
        yield from flushed()

    src = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return arrow_map(src, run, COUNTS).groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))


class Reference:
    """Shares of character classes and of common words (the last cell: all others) in a language."""

    def __init__(self, classes: np.ndarray, words: list[bytes], counts: np.ndarray):
        self.classes = classes / max(1, classes.sum())
        self.words = words
        self.shares = counts / max(1, counts.sum())

    def word_counts(self, lowered: Counter, total: int) -> np.ndarray:
        n = np.fromiter((lowered.get(w, 0) for w in self.words), dtype=np.float64, count=len(self.words))
        return np.append(n, total - n.sum())


def top_words(counts: DataFrame, common: int, least: str = "n") -> DataFrame:
    """The ``common`` first words of each language by ``n``; the best of each part of a language first, so that no task sorts all."""
    part = F.pmod(F.xxhash64("key"), F.lit(64))
    best = counts.withColumn("part", part).withColumn("r", F.row_number().over(W.partitionBy("lang", "part").orderBy(F.desc("n"), "key"))).where(F.col("r") <= common)
    return best.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= common).drop("part", "r")


def common_words(docs: DataFrame, n: DataFrame, langs: list[str], common: int, most: int = 2_000) -> dict[str, dict[str, int]]:
    """Exact counts of the ``common`` first words of each language, from a stored table of :func:`corpus_counts` with ``keep``."""
    word, off = n.where("kind = 'word'"), {r["lang"]: r["n"] for r in n.where("kind = 'off'").collect()}
    # the last of the first words has at least so much; words that can't reach it are out
    floor = top_words(word, common).groupBy("lang").agg(F.min("n").alias("floor"), F.count(F.lit(1)).alias("found"))
    known = {r["lang"]: r for r in floor.collect()}
    unsure = [x for x in langs if off.get(x, 0) and (x not in known or known[x]["found"] < common or known[x]["floor"] <= off[x])]
    cut = docs.sparkSession.createDataFrame([(x, known[x]["floor"] - off.get(x, 0)) for x in langs if x in known and x not in unsure and off.get(x, 0)] or [("", 0)], "lang string, least long")
    near = word.join(F.broadcast(cut), "lang").where("n >= least")
    wanted: dict[str, set[bytes]] = {}
    for r in near.groupBy("lang").count().collect():
        if r["count"] > most:  # so many words that may be the commonest: a corpus without common words
            unsure.append(r["lang"])
    for r in near.where(~F.col("lang").isin(unsure)).select("lang", "key").collect():
        wanted.setdefault(r["lang"], set()).add(r["key"].encode())
    sure = [x for x in langs if x not in unsure and x not in wanted]  # nothing was cut
    parts = [top_words(word.where(F.col("lang").isin(sure)), common)]
    if wanted:
        parts.append(top_words(stored(corpus_counts(docs.where(F.col("lang").isin(list(wanted))), only=wanted), "candidates").where("kind = 'word'"), common))
    if unsure:
        parts.append(top_words(stored(corpus_counts(docs.where(F.col("lang").isin(unsure))), "all-words").where("kind = 'word'"), common))
    out: dict[str, dict[str, int]] = {x: {} for x in langs}
    for p in parts:
        for r in p.select("lang", "key", "n").collect():
            out[r["lang"]][r["key"]] = r["n"]
    return out


def references(docs: DataFrame, common: int = 50, max_langs: int = 1_000, keep: int = 4_000) -> dict[str, Reference]:
    """Each language's reference; of the ``max_langs`` largest languages at most, with ``common`` words each."""
    n = stored(corpus_counts(docs, keep=keep), "counts")
    total = {r["lang"]: r["n"] for r in n.where("kind = 'total' AND n > 0").orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    classes: dict[str, dict[str, int]] = {}
    for r in n.where("kind = 'class'").join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in total] or [("",)], "lang string")), "lang").collect():
        classes.setdefault(r["lang"], {})[r["key"]] = r["n"]
    words = common_words(docs, n, list(total), common) if total else {}
    out = {}
    for lang in sorted(total):
        first = sorted(words[lang], key=lambda w: (-words[lang][w], w))
        counts = np.array([*(words[lang][w] for w in first), total[lang] - sum(words[lang].values())], dtype=np.float64)
        out[lang] = Reference(np.array([classes[lang].get(c, 0) for c in CLASSES], dtype=np.float64), [w.encode() for w in first], counts)
    return out


RULES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("class_distance", T.DoubleType()),
    T.StructField("word_distance", T.DoubleType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
])


def measure(text: str | None, lang: str | None, refs: dict[str, Reference], min_chars: int, min_words: int) -> tuple:
    """Base counts and the two noise-corrected distances (None: too short, or no reference)."""
    if not text:
        return 0, 0, 0, 0, 0, None, None
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    base = (len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS.encode())), dup_lines(text), repeat_words(words, counts))
    if not refs or not words:
        return *base, None, None
    classes, lowered = class_counts(raw), Counter()
    for w, n in counts.items():
        lowered[w.lower()] += n
    best = None
    for ref in [refs[lang]] if lang in refs else refs.values():
        c = d = None
        if len(text) >= min_chars:
            c = math.sqrt(max(0.0, divergence(classes, ref.classes) - noise(int((ref.classes > 0).sum()), len(text))))
        if len(words) >= min_words:
            d = math.sqrt(max(0.0, divergence(ref.word_counts(lowered, len(words)), ref.shares) - noise(len(ref.shares), len(words))))
        if best is None or (c or 0) + (d or 0) < (best[0] or 0) + (best[1] or 0):
            best = c, d
    return *base, *best


def rules(docs: DataFrame, refs: dict[str, Reference], max_class: float = 0.3, max_word: float = 0.28, min_chars: int = 200, min_words: int = 30, max_repeat_percent: int = 20, least_words: int = 10) -> DataFrame:
    """One row a document with counts, distances and verdict. No shuffle; the references are a few kilobytes."""
    bc = docs.sparkSession.sparkContext.broadcast(refs)

    def factory():
        known = bc.value

        def f(b: pa.RecordBatch) -> dict:
            rows = [measure(t, g, known, min_chars, min_words) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            n = list(zip(*rows, strict=True)) or [()] * 7
            failed = [r[0] < least_words or 100 * r[4] > max_repeat_percent * r[0] for r in rows]
            kept = [not x and (r[5] is None or r[5] <= max_class) and (r[6] is None or r[6] <= max_word) for x, r in zip(failed, rows, strict=True)]
            return dict(zip([x.name for x in RULES], [b.column(0), *n, failed, kept], strict=True))

        return f

    return map_batches(docs.select("doc_id", "text", "lang"), factory, RULES)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules(docs, references(docs)).drop("class_distance", "word_distance")


_BLANK, _NOT_BLANK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Characters of each class, as the bytes of :data:`CLASSES`.
_CLASS_SQL = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": _BLANK, "stop": "[.,;:!?]", "quote": "[''\"`-]", "bracket": r"[()\[\]{{}}]".replace("{{}}", "{}"), "control": r"[\x00-\x08\x0E-\x1F\x7F]",
    "symbol": r"[#$%&*+/<=>@\\^_|~]", "latin": r"[\x{80}-\x{FF}]", "other2": r"[\x{100}-\x{7FF}]", "three": r"[\x{800}-\x{FFFF}]", "four": r"[\x{10000}-\x{10FFFF}]",
}
_N_OF = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))" for p in _CLASS_SQL.values())
_JS = "sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2"
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, text IS NOT NULL AS has_text FROM documents),
b AS (SELECT *, regexp_extract_all(t, '{_NOT_BLANK}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_NOT_BLANK}')) AS ls FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 4], ' ')) AS n FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY 1),
base AS (SELECT b.rid AS rid, doc_id, lang, len(w) AS n_words, length(t) AS chars, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM b LEFT JOIN rep ON b.rid = rep.rid),
cls AS (SELECT rid, lang, has_text, unnest([{_N_OF}]) AS n, unnest(range(1, {len(_CLASS_SQL) + 1})) AS c FROM d),
rc AS (SELECT lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls WHERE lang IS NOT NULL AND has_text GROUP BY 1, 2),
wd AS (SELECT rid, lang, x, count(*) AS n FROM (SELECT rid, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM b) GROUP BY 1, 2, 3),
lw AS (SELECT lang, x, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, x, sum(n) AS n FROM wd WHERE lang IS NOT NULL GROUP BY 1, 2)),
top AS (SELECT lang, x, n / total AS q FROM lw WHERE r <= 50),
rw AS (SELECT * FROM top UNION ALL SELECT lang, NULL, 1 - sum(q) FROM top GROUP BY 1),
cells AS (SELECT lang, count(*) FILTER (q > 0) AS cc FROM rc GROUP BY 1), wcells AS (SELECT lang, count(*) AS wc FROM rw GROUP BY 1),
pair AS (SELECT rid, n_words, chars, r.lang AS ref FROM base JOIN wcells r ON base.lang = r.lang OR base.lang IS NULL OR base.lang NOT IN (SELECT lang FROM wcells) WHERE n_words > 0),
cd AS (SELECT pair.rid AS rid, ref, {_JS} AS js FROM (SELECT pair.rid, ref, q, n / sum(n) OVER (PARTITION BY pair.rid, ref) AS p FROM pair JOIN cls ON pair.rid = cls.rid JOIN rc ON rc.lang = ref AND rc.c = cls.c) pair GROUP BY 1, 2),
common AS (SELECT pair.rid AS rid, ref, rw.x AS x, q, coalesce(wd.n, 0) / n_words AS p FROM pair JOIN rw ON rw.lang = ref AND rw.x IS NOT NULL LEFT JOIN wd ON wd.rid = pair.rid AND wd.x = rw.x),
rest AS (SELECT common.rid AS rid, ref, NULL AS x, any_value(rw.q) AS q, 1 - sum(p) AS p FROM common JOIN rw ON rw.lang = ref AND rw.x IS NULL GROUP BY 1, 2),
wj AS (SELECT rid, ref, {_JS} AS js FROM (SELECT * FROM common UNION ALL SELECT * FROM rest) GROUP BY 1, 2),
dist AS (SELECT pair.rid AS rid, pair.ref AS ref, CASE WHEN chars >= 200 THEN sqrt(greatest(0, cd.js - (cc - 1) / (8 * chars * ln(2)))) END AS c, CASE WHEN n_words >= 30 THEN sqrt(greatest(0, wj.js - (wc - 1) / (8 * n_words * ln(2)))) END AS w
  FROM pair JOIN cd ON pair.rid = cd.rid AND pair.ref = cd.ref JOIN wj ON pair.rid = wj.rid AND pair.ref = wj.ref JOIN cells ON cells.lang = pair.ref JOIN wcells ON wcells.lang = pair.ref),
near AS (SELECT rid, c, w FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY coalesce(c, 0) + coalesce(w, 0), ref) AS r FROM dist) WHERE r = 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(c <= 0.3, true) AND coalesce(w <= 0.28, true) AS kept
FROM base LEFT JOIN near ON base.rid = near.rid
"""
