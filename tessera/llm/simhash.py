"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint bit is set where it is set in over half of a text's shingle
hashes. Fingerprints that differ in ``budget`` bits or less are linked, and
documents that are connected by links form a component.

Distribution: the bits are cut into ``budget + m`` blocks; two linked fingerprints
have at least ``m`` of them in common. So each distinct fingerprint goes to one
group for each choice of ``m`` blocks, keyed by the choice and their values; the
group is the part of a trie (over the fingerprint turned so that these blocks come
first) below those values. ``m`` follows from the number of fingerprints, so that
groups stay below ``chunk`` as the input grows: 5 keys of 12 bits for up to some
ten million, 15 of 21 bits up to some billions, 35 of 27 bits beyond.
Within a group the trie is joined with itself: pairs of nodes go down together,
each differing bit is added up, and a pair beyond the budget is pruned. A pair
whose leaves are all in one component already can't tell anything new and is
pruned too, so a group yields at most one link a fingerprint, whatever its size,
and no connection is lost. A group that is larger than ``chunk`` all the same is cut
into chunks and joined chunk by chunk in tasks of two chunks each.

Components come from alternating large and small stars over the links; each
half-step is a stored table, and hubs are salted.

Defined cases: null or empty text has fingerprint zero and is linked like any
other; very long texts are hashed to their end; a null ``doc_id`` has a fingerprint but
no component and links nothing; repeated rows have the same component; rows that repeat
an id with other texts link what these texts are near to; an empty table gives no rows;
other columns of ``docs`` are ignored by :func:`components_of` and kept, whatever their
names, by :func:`dedup`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import release, stored, table

from .common import arrow_map, map_batches, salted_left_join

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 64
#: Rows of a small table that may be broadcast.
MOST_BROADCAST = 200_000


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, seed)]
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stop = np.cumsum(size + 1) - 1
        hashes = [digest(line[a:b], seed) for a, b in zip((stop - size)[:1 - shingle].tolist(), stop[shingle - 1:].tolist(), strict=True)]
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 65_536):
        part = np.array(hashes[lo:lo + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, h, fp`` of every row: a hash of the text, and the fingerprint as a signed number. No shuffle."""

    def factory():
        def f(b: pa.RecordBatch) -> dict:
            got = np.fromiter((fingerprint(t, shingle) for t in b.column(2).to_pylist()), dtype=np.uint64, count=b.num_rows)
            return {"doc_id": b.column(0), "h": b.column(1), "fp": pa.array(got.view(np.int64))}

        return f

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), factory, PRINTS)


class Forest:
    """Component labels of places 0 to n - 1: the smallest place of a component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._runs()

    def _runs(self) -> None:
        self.change = np.concatenate([[0, 0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(2, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        differ = x != y
        if not differ.any():
            return
        pairs = np.unique(np.stack([np.maximum(x, y)[differ], np.minimum(x, y)[differ]], axis=1), axis=0)
        up = {}

        def root(k: int) -> int:
            while (p := up.get(k, k)) != k:
                up[k] = up.get(p, p)
                k = p
            return k

        for u, v in pairs.tolist():
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        old = np.fromiter(up, dtype=np.int64, count=len(up))
        turn = np.arange(len(self.label))
        turn[old] = [root(k) for k in old.tolist()]
        self.label = turn[self.label]
        self._runs()

    def one(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Whether all places of both ranges are in one component."""
        same = lambda lo, hi: self.change[hi] == self.change[lo + 1]
        return same(alo, ahi) & same(blo, bhi) & (self.label[alo] == self.label[blo])


def trie_join(values: np.ndarray, pairs: np.ndarray, budget: int, leaf: int = 16, at_once: int = 50_000) -> np.ndarray:
    """Labels of the components of ``values`` under links within the given node pairs.

    ``values``: unsigned numbers; ``pairs``: rows ``alo, ahi, blo, bhi`` of ranges of
    places, each range sorted by value (a trie), joined with each other or, if equal,
    with itself. Depth first in slices of ``at_once`` pairs, so memory is bounded.
    """
    forest = Forest(len(values))
    zeros: dict[int, np.ndarray] = {}

    def split(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in zeros:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)])
        return lo + zeros[depth][hi] - zeros[depth][lo]

    stack = [(0, pairs, np.zeros(len(pairs), dtype=np.int64))]
    while stack:
        depth, p, errors = stack.pop()
        if len(p) > at_once:
            stack += [(depth, p[at_once:], errors[at_once:]), (depth, p[:at_once], errors[:at_once])]
            continue
        open_ = ~forest.one(p[:, 0], p[:, 1], p[:, 2], p[:, 3])
        p, errors = p[open_], errors[open_]
        if not len(p):
            continue
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        small = na * nb <= leaf if depth < BITS else np.ones(len(p), dtype=bool)
        if small.any():
            q, m = p[small], (na * nb)[small]
            which = np.repeat(np.arange(len(q)), m)
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a, b = q[which, 0] + k // nb[small][which], q[which, 2] + k % nb[small][which]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            forest.link(a[near], b[near])
        p, errors = p[~small], errors[~small]
        if not len(p):
            continue
        own = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        am, bm = split(depth, p[:, 0], p[:, 1]), split(depth, p[:, 2], p[:, 3])
        ways = [
            (np.stack([p[:, 0], am, p[:, 2], bm], axis=1), errors, None),
            (np.stack([am, p[:, 1], bm, p[:, 3]], axis=1), errors, None),
            (np.stack([p[:, 0], am, bm, p[:, 3]], axis=1), errors + 1, None),
            (np.stack([am, p[:, 1], p[:, 2], bm], axis=1), errors + 1, ~own),  # of a node with itself, once is enough
        ]
        nxt, err = [], []
        for q, e, only in ways:
            keep = (e <= budget) & (q[:, 0] < q[:, 1]) & (q[:, 2] < q[:, 3]) & ~((q[:, 1] - q[:, 0] == 1) & (q[:, 0] == q[:, 2]) & (q[:, 1] == q[:, 3]))
            keep = keep if only is None else keep & only
            nxt.append(q[keep])
            err.append(e[keep])
        stack.append((depth + 1, np.concatenate(nxt), np.concatenate(err)))
    return forest.label


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def agreeing(n: int, budget: int, chunk: int, most: int = 4) -> int:
    """How many blocks must agree, so that ``n`` evenly spread fingerprints are repeated least: once a choice of blocks and chunk of a group."""

    def rows(m: int) -> float:
        return math.comb(budget + m, m) * max(1.0, 2 * n / 2.0 ** (BITS // (budget + m) * m) / chunk)

    return min(range(1, most + 1), key=rows)


def dealt(prints: DataFrame, budget: int, chunk: int, n: int) -> DataFrame:
    """Each distinct ``fp`` once for each group (and pair of chunks) that it belongs to: ``k, v, lo, hi, second, x, fp``."""
    m = agreeing(n, budget, chunk)
    blocks = budget + m
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    size = [b - a for a, b in zip(bounds, bounds[1:])]

    def keyed_by(k: int, choice: tuple[int, ...]) -> Column:
        """The fingerprint with the chosen blocks first, and their values."""
        x, at = F.lit(0).cast("long"), BITS
        for j in [*choice, *(j for j in range(blocks) if j not in choice)]:
            at -= size[j]
            part = F.shiftrightunsigned("fp", BITS - bounds[j + 1]).bitwiseAND(F.lit((1 << size[j]) - 1).cast("long"))
            x = x.bitwiseOR(F.shiftleft(part, at))
        return F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(x, BITS - sum(size[j] for j in choice)).alias("v"), x.alias("x"))

    keyed = prints.select("fp", F.explode(F.array(*[keyed_by(k, c) for k, c in enumerate(itertools.combinations(range(blocks), m))])).alias("s")).select("fp", "s.*")
    many = stored(keyed.groupBy("k", "v").count().where(F.col("count") > chunk).select("k", "v", F.ceil(F.col("count") / chunk).cast("int").alias("m")), "large-groups")
    held = keyed.join(F.broadcast(many) if many.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else many, ["k", "v"], "left")
    parts = F.coalesce("m", F.lit(1))
    held = held.withColumn("c", F.pmod(F.xxhash64("x"), parts).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    return held.select("k", "v", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), (F.col("c") > F.col("o")).alias("second"), "x", "fp")


def links(prints: DataFrame, budget: int = 4, chunk: int = 4_096, gather: int = 100_000) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``fp`` as all links would."""
    arrow = to_arrow_schema(EDGES)
    names = ["k", "v", "lo", "hi"]

    def joined(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        x, fp = cols["x"].view(np.uint64), cols["fp"]
        order = np.lexsort((x, cols["second"], cols["hi"], cols["lo"], cols["v"], cols["k"]))
        cols = {c: a[order] for c, a in cols.items()}
        x, fp = x[order], fp[order]
        edge = lambda cs: np.flatnonzero(np.concatenate([[True], np.any([cols[c][1:] != cols[c][:-1] for c in cs], axis=0)]))
        start = edge(names)
        stop = np.append(start[1:], len(x))
        part = edge([*names, "second"])
        part_stop = np.append(part[1:], len(x))
        own = cols["lo"][start] == cols["hi"][start]
        pairs = [np.stack([start, stop, start, stop], axis=1)[own]]
        i = np.searchsorted(part, start[~own])
        two = part_stop[i] < stop[~own]
        i = i[two]
        pairs.append(np.stack([part[i], part_stop[i], part[np.minimum(i + 1, len(part) - 1)], part_stop[np.minimum(i + 1, len(part) - 1)]], axis=1))
        label = trie_join(x, np.concatenate(pairs), budget)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[label[child]])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append({n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)})
            size += b.num_rows
            if size >= gather:
                cols = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                last = np.flatnonzero(np.any([cols[n] != cols[n][-1] for n in names], axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                if cut:
                    yield joined({n: a[:cut] for n, a in cols.items()})
                held, size = [{n: a[cut:] for n, a in cols.items()}], len(cols["x"]) - cut
        if held:
            yield joined({n: np.concatenate([h[n] for h in held]) for n in held[0]})

    return arrow_map(dealt(prints, budget, chunk, prints.count()).repartition(*names).sortWithinPartitions(*names), run, EDGES)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node that isn't its component's smallest, by alternating large and small stars."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        first = e
        around = e.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(e.select(F.col("u").alias("n"), F.col("v").alias("m")))
        large_least = stored(around.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"), F.sum(F.when(F.col("m") > F.col("n"), 1).otherwise(0)).alias("rows")).where("rows > 0"), "large")
        large = salted_left_join(e.withColumnRenamed("v", "n"), large_least, ["n"], ["u"], n="rows").select("u", F.col("least").alias("v"))
        middle = e = stored(large.distinct(), "edges")
        least = stored(e.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("rows")), "small")
        small = salted_left_join(e, least, ["u"], ["v"], n="rows")
        small = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        e = stored(small.distinct(), "edges")
        release(first, large_least, middle, least)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def labelled(prints: DataFrame, budget: int, by_id: bool) -> DataFrame:
    """``fp, root, component_id, n`` of each distinct fingerprint of a stored table ``doc_id, h, fp``; ``n`` counts its rows.

    ``by_id``: fingerprints of one id are linked, too.
    """
    reps = stored(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "representatives")
    edges = links(reps.select("fp"), budget)
    if by_id:
        several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top"), F.count(F.lit(1)).alias("n")).where("b <> top").drop("top")
        several = stored(several, "several")
        if not several.isEmpty():
            own = salted_left_join(prints.where("doc_id IS NOT NULL").select("doc_id", F.col("fp").alias("a")).distinct(), several, ["doc_id"], ["a"])
            edges = edges.unionByName(own.where("b IS NOT NULL").select("a", "b"))
    found = stored(connected(edges), "components")
    linked = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    linked = stored(linked.join(reps.select(F.col("fp").alias("node"), "rep"), "node"), "linked")
    least = stored(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    linked = salted_left_join(linked, least, ["root"], ["node"]).select(F.col("node").alias("fp"), "root", "component_id")
    roots = reps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"), "n")
    return stored(roots, "roots")


def components_of(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    got = salted_left_join(prints, labelled(prints, budget, by_id=True), ["fp"], ["doc_id"])
    return got.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` with one row of each component of linked texts, that of the smallest id; rows with a null id all stay.

    Rows are told apart by id and a hash of the text, so that no text is lost where rows repeat an id with
    others; of rows equal in both, one stays. What goes is decided on ids and hashes; then texts are moved once,
    by an anti join.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    rows = prints.where("doc_id IS NOT NULL").groupBy("doc_id", "h", "fp").agg(F.count(F.lit(1)).alias("times"))
    rows = stored(salted_left_join(rows, labelled(prints, budget, by_id=False).drop("component_id"), ["fp"], ["doc_id"]), "rows")
    first = stored(rows.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    own = F.struct("doc_id", "h")
    judged = salted_left_join(rows, first, ["root"], ["doc_id", "h"]).select("doc_id", "h", "times", (own != F.col("first")).alias("gone"))
    judged = stored(judged.where("gone OR times > 1"), "judged")
    mark = "__h"
    while mark in docs.columns:
        mark += "_"
    keys = ["doc_id", mark]
    judged = judged.withColumnRenamed("h", mark)
    hot = F.col("times") > max(1_000, (rows.agg(F.sum("times")).first()[0] or 0) // 100_000)  # so at most 100,000 keys are hot
    gone, again = judged.where("gone").select(*keys, "times"), judged.where("NOT gone").select(*keys, "times")
    left = docs.withColumn(mark, F.xxhash64("text")).join(F.broadcast(gone.where(hot).select(*keys)), keys, "left_anti").join(gone.where(~hot).select(*keys), keys, "left_anti")
    if not again.isEmpty():
        once = left.join(F.broadcast(again.where(hot).select(*keys)), keys, "left_semi").dropDuplicates(keys)  # combined before the shuffle
        cold = left.join(F.broadcast(again.where(hot).select(*keys)), keys, "left_anti")
        once = once.unionByName(cold.join(again.where(~hot).select(*keys), keys, "left_semi").dropDuplicates(keys))
        left = once.unionByName(cold.join(again.where(~hot).select(*keys), keys, "left_anti"))
    return left.select(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    got = components_of(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
