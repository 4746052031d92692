"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every substring of the normalised benchmark items. Each
document's words are streamed through it; the longest match ending at every
word is tracked, and words inside an occurrence of a window (``window``
consecutive item words, or the whole of a shorter item) are hit.

The benchmark is streamed to the driver item by item and cut into blocks of at
most ``max_block_words`` words, and blocks into passes of at most
``max_pass_words``. A pass broadcasts its items' words, documents go through one
map, and a task builds one block's automaton at a time, scans what it has
gathered of documents and lets go of it. So what is broadcast and held at once
has a fixed bound however large the benchmark grows, and nothing is shuffled;
only between passes, if there is more than one, a table is stored.

Defined cases: null or empty text has no words, no hits and is never
contaminated; items without words are ignored; an item with a null id counts for
hits but isn't listed; items that repeat an id are one item, equal items with two
ids are two; repeated rows are treated one by one; very long texts are scanned to
their end; an empty benchmark hits nothing; extra columns of ``docs`` are kept by
:func:`decontaminate`, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import stored

from .common import ASCII_LOWER, ASCII_UPPER, arrow_map

#: Upper case to lower case, all other ASCII characters that are no word character to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
MATCHES = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

Item = tuple[str | None, list[bytes]]
Span = tuple[int, int]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[Item], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        n = len(self.link)
        #: Items in which the state's strings occur; shorter items that are a suffix of the state's longest string.
        self.items: list[set[str | None]] = [set() for _ in range(n)]
        whole: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        for name, ws in items:
            s = 0
            for w in ws:
                s = self.step[s][w]
                t = s
                while t > 0 and name not in self.items[t]:
                    self.items[t].add(name)
                    t = self.link[t]
            if len(ws) < window:
                whole[s].append((len(ws), name))
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        self.top = [0] * n  # the state of the suffix of exactly window words
        for s in sorted(range(1, n), key=self.length.__getitem__):
            p = self.link[s]
            self.short[s] = self.short[p] + whole[s]
            self.top[s] = self.top[p] if self.length[p] >= window else s
        self.any_short = any(self.short)

    def _extend(self, last: int, w: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = step[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _state(self, step: dict[bytes, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def scan(self, words: list[bytes]) -> tuple[list[Span], set[str]]:
        """Merged spans of hit words, and the items whose windows occur."""
        step, link, length, window, short = self.step, self.link, self.length, self.window, self.short
        root = step[0]
        state = matched = 0
        spans: list[list[int]] = []
        found: set[str | None] = set()
        for i, w in enumerate(words):
            if state == 0:
                if w not in root:
                    continue
                state, matched = root[w], 1
            else:
                nxt = step[state].get(w)
                while nxt is None and state:
                    state = link[state]
                    matched = length[state]
                    nxt = step[state].get(w)
                if nxt is None:
                    matched = 0
                    continue
                state, matched = nxt, matched + 1
            reach = 0
            if matched >= window:
                reach = window
                found |= self.items[self.top[state]]
            if short[state]:
                for m, name in short[state]:
                    if m <= matched:
                        reach = max(reach, m)
                        found.add(name)
            if reach:
                lo = i + 1 - reach
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        return [(a, b) for a, b in spans], found - {None}


def item_blocks(benchmark: DataFrame, max_block_words: int, least_item_words: int = 1) -> Iterator[list[Item]]:
    """The items with words, streamed to the driver in blocks of a bounded size."""
    block, n, same = [], 0, {}
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        if len(ws := words_of(row[1])) >= max(1, least_item_words):
            if block and n + len(ws) > max_block_words:
                yield block
                block, n, same = [], 0, {}
            block.append((row[0], [same.setdefault(w, w) for w in ws]))
            n += len(ws)
    if block:
        yield block


def passes(benchmark: DataFrame, max_block_words: int, max_pass_words: int, least_item_words: int = 1) -> Iterator[tuple[list[list[Item]], bool]]:
    """Blocks that are broadcast together, and whether they are the last."""
    held: list[list[Item]] = []
    n = 0
    for block in item_blocks(benchmark, max_block_words, least_item_words):
        size = sum(len(ws) for _, ws in block)
        if held and n + size > max_pass_words:
            yield held, False
            held, n = [], 0
        held.append(block)
        n += size
    yield held, True


def merge_spans(spans: list[Span]) -> list[Span]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The automaton that this worker built last, after its block.
_BUILT: list = [None, None]


def scan_all(bc: Broadcast, window: int, texts: list[list[bytes]]) -> list[tuple[list[Span], set[str]]]:
    """Spans and items of each word list over all blocks, with one automaton in memory at a time."""
    got: list[tuple[list[Span], set[str]]] = [([], set()) for _ in texts]
    for block in bc.value:
        if _BUILT[0] is not block or _BUILT[1].window != window:
            _BUILT[:] = None, None
            _BUILT[:] = block, SuffixAutomaton(block, window)
        sam = _BUILT[1]
        for i, ws in enumerate(texts):
            spans, items = sam.scan(ws)
            if spans:
                old = got[i]
                got[i] = (merge_spans([*old[0], *spans]) if old[0] else spans, old[1] | items)
    return got


def gathered(batches: Iterable[pa.RecordBatch], several: bool, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches put together, so that building several automata pays; one block needs no gathering."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not several:
            yield b
            continue
        held.append(b)
        size += b.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_block_words: int = 200_000, max_pass_words: int = 2_000_000) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row: one map a pass, no shuffle."""
    df, first = docs.select("doc_id", "text"), True
    for blocks, last in passes(benchmark, max_block_words, max_pass_words):
        schema = T.StructType([df.schema["doc_id"], *([] if last else [df.schema["text"]]), *MATCHES])
        bc = df.sparkSession.sparkContext.broadcast(blocks)

        def run(batches, bc=bc, first=first, last=last, schema=schema):
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for b in gathered(batches, len(bc.value) > 1):
                texts = [words_of(t) for t in b.column(1).to_pylist()]
                got = scan_all(bc, window, texts)
                if not first:
                    got = [(merge_spans([*spans, *((s["start"], s["end"]) for s in x["spans"])]), items | set(x["items"])) for (spans, items), x in zip(got, b.select(["spans", "items"]).to_pylist(), strict=True)]
                cols = [list(map(len, texts)), [[{"start": a, "end": z} for a, z in spans] for spans, _ in got], [sorted(items) for _, items in got]]
                yield pa.RecordBatch.from_arrays([b.column(0), *([] if last else [b.column(1)]), *[pa.array(c, type=arrow.field(f.name).type) for c, f in zip(cols, MATCHES, strict=True)]], schema=arrow)

        df, first = arrow_map(df, run, schema), False
        if not last:
            df = stored(df, "matches")
            bc.destroy()
    return df


def without(raw: bytes, folded: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of spans, which are in order and don't overlap."""
    at = [m.span() for m in _WORD.finditer(folded)]
    parts, last = [], 0
    for a, b in spans:
        parts.append(raw[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")


STATE = T.StructType([T.StructField("n_all", T.LongType()), T.StructField("gone", T.LongType()), T.StructField("spans", SPANS), T.StructField("more", T.BooleanType())])


def cut(docs: DataFrame, bc: Broadcast, window: int, state: str, first: bool, last: bool, max_span_words: int, max_coverage: float) -> DataFrame:
    """One pass over ``docs``. The last pass of a round cuts; if it is the first too, rounds go on here until nothing is cut.

    The struct column ``state`` carries the original word count, the words cut so far, the spans found by
    earlier passes and, after the last one, whether the text was cut and needs another round.
    """
    at, held = docs.columns.index("text"), docs.columns.index(state)

    def run(batches):
        for b in gathered(batches, len(bc.value) > 1):
            texts, states, kept = b.column(at).to_pylist(), b.column(held).to_pylist(), [True] * b.num_rows
            todo = [i for i, t in enumerate(texts) if t]
            while todo:
                raws = [texts[i].encode("utf-8", "surrogatepass") for i in todo]
                folded = [r.translate(_FOLD) for r in raws]
                words = [f.split() for f in folded]
                again = []
                for i, raw, fold, ws, (spans, _) in zip(todo, raws, folded, words, scan_all(bc, window, words), strict=True):
                    x = states[i] or {"n_all": len(ws), "gone": 0, "spans": []}
                    spans, gone, more = merge_spans([*spans, *((s["start"], s["end"]) for s in x["spans"] or [])]), x["gone"], False
                    if last and spans:
                        kept[i] = gone + sum(z - a for a, z in spans) <= max_coverage * x["n_all"]
                        spans = [(a, z) for a, z in spans if z - a >= max_span_words]
                        if more := kept[i] and bool(spans):
                            gone += sum(z - a for a, z in spans)
                            texts[i] = without(raw, fold, spans)
                            again.append(i)
                    states[i] = {"n_all": x["n_all"], "gone": gone, "spans": [] if last else [{"start": a, "end": z} for a, z in spans], "more": more}
                todo = again if first else []
            b = b.set_column(held, b.schema.field(held), pa.array(states, type=b.schema.field(held).type))
            if last:
                b = b.set_column(at, b.schema.field(at), pa.array(texts, type=b.schema.field(at).type)).filter(pa.array(kept, type=pa.bool_()))
            yield b

    return arrow_map(docs, run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span_words: int = 1, max_coverage: float = 0.5, max_block_words: int = 200_000, max_pass_words: int = 2_000_000, least_item_words: int = 1) -> DataFrame:
    """``docs`` with benchmark spans cut out; documents mostly made of such spans are dropped.

    Spans of at least ``max_span_words`` hit words are cut, and a document goes if more than
    ``max_coverage`` of its original words are hit. Cutting is repeated until no window is left, as
    joining the rest of a text can make a new one. Coverage is what all blocks hit together, so
    results don't depend on the number of blocks or passes: with several passes, each round takes all of
    them and is stored, and only documents that were cut go into the next. Items of fewer than
    ``least_item_words`` words are left out; with the default of 1, none are.
    """
    state = "__cut"
    while state in docs.columns:
        state += "_"
    todo, done, sc = docs.withColumn(state, F.lit(None).cast(STATE)), [], docs.sparkSession.sparkContext
    while True:
        first = True
        for blocks, last in passes(benchmark, max_block_words, max_pass_words, least_item_words):
            if not blocks:
                return docs
            bc = sc.broadcast(blocks)
            todo = cut(todo, bc, window, state, first, last, max_span_words, max_coverage)
            if first and last:
                return todo.drop(state)
            todo, first = stored(todo, "decontaminated"), False
            bc.destroy()
        more = F.coalesce(F.col(state)["more"], F.lit(False))
        done.append(todo.where(~more).drop(state))
        todo = todo.where(more)
        if todo.isEmpty():
            return functools.reduce(DataFrame.union, done)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from tessera.session import table

    got = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = rf"regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win))),
hits AS (SELECT doc_id, i, dwin.k AS k, item_id FROM dwin JOIN win ON dwin.k = win.k AND dwin.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT dw.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
