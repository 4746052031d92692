"""Prefix trie of conversations.

Conversations are rebuilt so that some share their first turns with another, and every distinct
sequence of first turns is a node. A turn is known by a digest of role and text, a node by a
chained digest of its turns (128 bits, two numbers), so after the first shuffle rows are
small whatever the texts are.

1. *Chains.* A conversation and those that may take its first turns lie in one partition, sorted; a map streams over
   the rows with one digest in memory and yields a row for each conversation and depth. This is the only step that
   needs a conversation's rows in order, and it holds one row of them.
2. *Nodes* are sums of these rows, combined before they are shuffled, so turns that very many conversations share cost
   nothing more. *Edges* join nodes with the same members: runs without a branch or an end in between, again a sum, by smallest member
   and number of members, which tell them apart.
3. *Tries.* Only edges with two members or more go on: what lies below a branch with one member is a
   chain whose figures are known. They are partitioned by the digest of the first turn;
   a first turn with more than ``most`` edges below it is divided by its next turn, and that again, as often as needed. The
   parts are dealt over hash buckets. Each bucket builds pointer tries in dictionaries inside ``applyInPandas`` and walks them
   in postorder with a stack of its own. What was divided is summed from its parts.
4. *Ends.* Ids that end at a node are sorted by range over all partitions; a range's inner nodes are digested there, and
   what crosses ranges is digested from a few long pieces.

Defined cases: rows with a null ``conv_id`` are left out; null role or text is empty; a null turn comes first, and equal
turns go by the digest of role and text; repeated rows are turns each; a conversation whose turns are all replaced by those of an absent one is turnless and ends at
the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import release, stored, table

from .common import arrow_map, salted_left_join

FAMILY, HEADS = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()
#: Edges below one turn that a task takes, and edges of a bucket.
MOST, BUCKET = 200_000, 50_000

PATH = T.StructType([T.StructField(n, T.LongType()) for n in ("n1", "n2", "p1", "p2", "f1", "f2", "conv_id", "depth", "words", "total")] + [T.StructField("last", T.IntegerType())])
SUMS = "b1 long, b2 long, leaves long, saved long, above array<long>"
ENDS = T.StructType([T.StructField("n1", T.LongType()), T.StructField("n2", T.LongType()), T.StructField("first", T.LongType()), T.StructField("piece", T.BinaryType()), T.StructField("digest", T.StringType())])


def taken(c: int) -> int:
    """How many first turns conversation ``c`` takes from the first of its family."""
    return zlib.crc32(str(c).encode()) % HEADS


def family(c: Column) -> Column:
    return c - c % FAMILY


def paths(conversations: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and depth, 0 included: its node, that node's parent, the node of depth 1, words of the last turn and of all, and whether it ends there."""
    turn = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    t = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("conv_id", family(F.col("conv_id")).alias("family"), "turn", F.unhex(F.substring(F.sha2(turn.cast("binary"), 256), 1, 32)).alias("digest"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    t = t.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "digest")
    arrow = to_arrow_schema(PATH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        out: list[list[int]] = []
        now = group = None
        head: list[tuple[bytes, int]] = []
        row: list[int] = []
        node, place, skip = b"", 0, 0

        def step(digest: bytes, words: int) -> None:
            nonlocal node, row
            out.append(row)
            up = row
            node = hashlib.sha256(node + digest).digest()[:16]
            n1, n2 = struct.unpack(">qq", node)
            first = up[4:6] if up[7] else [n1, n2]
            row = [n1, n2, up[0], up[1], *first, now, up[7] + 1, words, up[9] + words, 0]

        def flush() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [[]] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(c, a.type) for c, a in zip(cols, arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        for b in batches:
            for c, fam, digest, words in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if c != now:
                    if row:
                        row[10] = 1
                        out.append(row)
                    if fam != group:
                        group, head = fam, []
                    now, node, place, row = c, bytes(16), 0, [0, 0, 0, 0, 0, 0, c, 0, 0, 0, 0]
                    skip = 0 if c == fam else taken(c)
                    for h in head[:skip]:
                        step(*h)
                if c == fam and place < HEADS - 1:
                    head.append((digest, words))
                place += 1
                if place > skip:
                    step(digest, words)
            if out:
                yield flush()
        if row:
            row[10] = 1
            out.append(row)
            yield flush()

    return arrow_map(t, run, PATH, 10_000)


def nodes_of(path: DataFrame) -> DataFrame:
    """A row for each node; ``end`` is the smallest conversation that ends there."""
    one = lambda c: F.min(c).alias(c)  # noqa: E731  the same in all rows of a node
    ends = F.when(F.col("last") == 1, F.col("conv_id"))
    return path.groupBy("n1", "n2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *map(one, ("p1", "p2", "f1", "f2", "depth", "words", "total")), F.sum("last").alias("n_ends"), F.min(ends).alias("end"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """Runs of nodes with the same members: nodes at top ``t``, bottom ``b``, and above ``p``; depths, words, branches at the bottom (``singles``: of one member)."""
    at = lambda f, c, name: f(c, "depth").alias(name)
    e = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.count(F.lit(1)).alias("nodes"), at(F.min_by, F.col("total") - F.col("words"), "before"), F.max("total").alias("total"),
        *[at(F.min_by, f"n{k}", f"t{k}") for k in "12"], *[at(F.max_by, f"n{k}", f"b{k}") for k in "12"], *[at(F.min_by, f"p{k}", f"p{k}") for k in "12"], *[at(F.max_by, f"f{k}", f"f{k}") for k in "12"],
    )
    runs = e = stored(e, "trie-runs")
    below = e.where("top > 0").groupBy(F.col("p1").alias("b1"), F.col("p2").alias("b2")).agg(F.count(F.lit(1)).alias("branches"), F.sum((F.col("n_convs") == 1).cast("int")).alias("singles"))
    e = stored(e.join(below, ["b1", "b2"], "left").fillna(0, ["branches", "singles"]), "trie-branches")
    up = e.select(F.col("b1").alias("p1"), F.col("b2").alias("p2"), F.col("conv_id").alias("parent"), F.col("branches").alias("n")).where("n > 0")
    got = stored(salted_left_join(e, up, ["p1", "p2"], ["conv_id", "n_convs"]), "trie-edges")
    release(runs, e)
    return got


def divided(edges: DataFrame, path: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Shared edges below the root with the turn ``g`` they are partitioned by, and the edges that were divided; ``above``: the divided ones above each."""
    cols = ["b1", "b2", "p1", "p2", "t1", "t2", "conv_id", "top", "bottom", "own", "singles", "leaf", "f1", "f2"]
    shared = edges.where("n_convs > 1").withColumn("own", (F.col("n_convs") - 1) * (F.col("total") - F.col("before"))).withColumn("leaf", (F.col("branches") == 0).cast("long"))
    start = F.array().cast("array<long>")
    root = shared.where("top = 0").select(*cols, start.alias("above"))
    first = root.select("bottom", "b1", "b2").first()
    if first is None:
        return shared.where("false").select(*cols, start.alias("above"), F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2")), [root]

    def next_turn(e: DataFrame) -> DataFrame:
        """``e`` with its conversation's node at depth ``at`` as ``g``."""
        there = path.select("conv_id", F.col("depth").alias("at"), F.col("n1").alias("g1"), F.col("n2").alias("g2"))
        return e.join(there, ["conv_id", "at"]).drop("at")

    rest = shared.where("top > 0").select(*cols, F.array(F.lit(first["b1"]), F.lit(first["b2"])).alias("above"))
    rest = rest.withColumns({"g1": F.col("f1"), "g2": F.col("f2")}) if not first["bottom"] else next_turn(rest.withColumn("at", F.lit(first["bottom"] + 1).cast("long")))
    done, split = [], [root]
    while True:
        rest = stored(rest, "trie-parts")
        large = rest.groupBy("g1", "g2").count().where(F.col("count") > most)
        large = stored(large.join(rest.select(F.col("t1").alias("g1"), F.col("t2").alias("g2"), F.col("b1").alias("x1"), F.col("b2").alias("x2"), (F.col("bottom") + 1).alias("at")), ["g1", "g2"]).withColumnRenamed("count", "n"), "trie-large")
        if large.isEmpty():
            done.append(rest)
            break
        marked = stored(salted_left_join(rest, large, ["g1", "g2"], ["b1", "b2"]), "trie-marked")
        done.append(marked.where("at IS NULL").drop("at", "x1", "x2"))
        own = (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))
        split.append(marked.where(F.col("at").isNotNull() & own).select(*cols, "above"))
        rest = next_turn(marked.where(F.col("at").isNotNull() & ~own).withColumn("above", F.concat("above", F.array("x1", "x2"))).drop("g1", "g2", "x1", "x2"))
    got = done[0]
    for d in done[1:]:
        got = got.unionByName(d)
    return got, split


def postorder(p: pd.DataFrame) -> pd.DataFrame:
    """Leaves and saved words below each edge of a bucket: a pointer trie for each of its parts, walked without recursion. Tops also say what was divided above them."""
    names = list(zip(p["b1"], p["b2"], strict=True))
    at = {name: k for k, name in enumerate(names)}
    below: list[dict[tuple[int, int], int]] = [{} for _ in names]
    tops = []
    for k, (up, turn) in enumerate(zip(zip(p["p1"], p["p2"], strict=True), zip(p["t1"], p["t2"], strict=True), strict=True)):
        if (parent := at.get(up)) is None:
            tops.append(k)
        else:
            below[parent][turn] = k
    leaves, saved = (p["leaf"] + p["singles"]).tolist(), p["own"].tolist()
    for top in tops:
        stack = [(top, iter(below[top].values()))]
        while stack:
            k, children = stack[-1]
            child = next(children, None)
            if child is not None:
                stack.append((child, iter(below[child].values())))
                continue
            stack.pop()
            if stack:
                leaves[stack[-1][0]] += leaves[k]
                saved[stack[-1][0]] += saved[k]
    above: list = [None] * len(names)
    for k in tops:
        above[k] = p["above"].iloc[k]
    return pd.DataFrame({"b1": p["b1"], "b2": p["b2"], "leaves": leaves, "saved": saved, "above": above})


def summed(edges: DataFrame, path: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """``b1, b2, leaves, saved`` of each shared edge."""
    parts, split = divided(edges, path, most)
    parts = stored(parts, "trie-parts")
    buckets = max(1, math.ceil(parts.count() / bucket))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)))
    low = stored(dealt.groupBy("bucket").applyInPandas(postorder, SUMS), "trie-sums")
    own = split[0]
    for s in split[1:]:
        own = own.unionByName(s)
    own = own.select((F.col("leaf") + F.col("singles")).alias("leaves"), F.col("own").alias("saved"), F.concat("above", F.array("b1", "b2")).alias("above"))
    pair = lambda i: F.struct(F.get("above", 2 * i).alias("b1"), F.get("above", 2 * i + 1).alias("b2"))
    up = own.unionByName(low.where("above IS NOT NULL").select("leaves", "saved", "above"))
    up = up.select("leaves", "saved", F.explode(F.transform(F.sequence(F.lit(0), (F.size("above") / 2 - 1).cast("int")), pair)).alias("x"))
    high = up.groupBy("x.b1", "x.b2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return low.drop("above").unionByName(high)


def digests(path: DataFrame, ids_a_piece: int = 20_000) -> DataFrame:
    """``n1, n2, digest``: of the comma-joined ascending ids of conversations that end at a node, for every node with two or more (some with one)."""
    arrow = to_arrow_schema(ENDS)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, a.type) for c, a in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, ids, first = None, [], True

        def close(outer: bool) -> Iterable[pa.RecordBatch]:
            if outer:  # the node may go on in the range before or after
                for k in range(0, len(ids), ids_a_piece):
                    yield batch([(*now, ids[k], ",".join(map(str, ids[k:k + ids_a_piece])).encode(), None)])
            elif len(ids) > 1:
                yield batch([(*now, ids[0], None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())])

        for b in batches:
            for *node, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if node != now:
                    if now:
                        yield from close(first)
                        first = False
                    now, ids = node, []
                ids.append(c)
        if now:
            yield from close(True)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now = sha = None
        for b in batches:
            for n1, n2, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (n1, n2) != now:
                    if now:
                        yield batch([(*now, None, None, sha.hexdigest())])
                    now, sha = (n1, n2), hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
        if now:
            yield batch([(*now, None, None, sha.hexdigest())])

    ends = path.where("last = 1").select("n1", "n2", "conv_id")
    got = stored(arrow_map(ends.repartitionByRange("n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id"), ranged, ENDS, 10_000), "trie-ends")
    outer = arrow_map(got.where("digest IS NULL").repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first"), chained, ENDS, 100)
    return got.where("digest IS NOT NULL").unionByName(outer).select("n1", "n2", "digest")


def trie(conversations: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: smallest member, depth, parent, members, children, leaves and saved words below, digest of ends."""
    path = stored(paths(conversations), "trie-paths")
    nodes = stored(nodes_of(path), "trie-nodes")
    edges = edges_of(nodes)
    full = edges.join(summed(edges, path, most, bucket), ["b1", "b2"], "left").select("conv_id", "n_convs", "top", "bottom", "before", "parent", "branches", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.col("nodes").alias("n"))
    full = stored(full, "trie-full")
    release(edges)
    each = salted_left_join(nodes, full, ["conv_id", "n_convs"], ["depth"]).join(digests(path), ["n1", "n2"], "left")
    top, bottom = F.col("depth") == F.col("top"), F.col("depth") == F.col("bottom")
    ends = F.when(F.col("n_ends") == 0, NOTHING).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string").cast("binary"), 256)).otherwise(F.col("digest"))
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.when(top, F.col("parent")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs", F.when(bottom, F.col("branches")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("total") - F.col("words") - F.col("before"))).alias("saved_tokens"), ends.alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS family,
    list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM (SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (SELECT conv_id, family, xor(crc, 4294967295) % 4 AS h FROM ids),
rebuilt AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth
  FROM (SELECT i.conv_id, 0 AS own, t.place, t.digest, t.words FROM heads i JOIN turns t ON t.conv_id = i.family AND t.place <= i.h
        UNION ALL SELECT i.conv_id, 1, t.place, t.digest, t.words FROM heads i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h)),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS words FROM ids
  UNION ALL SELECT r.conv_id, r.depth, sha256(p.node || r.digest), p.node, r.words FROM path p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
marked AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM path),
node AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM marked GROUP BY node),
child AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
above AS (
  SELECT n.node AS low, n.node AS high FROM node n
  UNION ALL SELECT a.low, n.parent FROM above a JOIN node n ON n.node = a.high WHERE n.parent IS NOT NULL),
below AS (
  SELECT a.high AS node, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM above a JOIN node n ON n.node = a.low LEFT JOIN child c ON c.node = a.low GROUP BY a.high)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.node = n.node LEFT JOIN child c ON c.node = n.node LEFT JOIN node p ON p.node = n.parent"""
