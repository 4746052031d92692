"""Prefix trie, whitening and nearest neighbours against brute force, and their defined cases."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours, prefix_trie, queries, whitening
from tests.oracle import connect, same

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    """Nodes as a dictionary from each sequence to its members, everything else by walking all of them."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        first, h = c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(first, [])[:h] + turns[h:]
    nodes = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for s, members in nodes.items():
        under = [t for t in nodes if t[:len(s)] == s]
        children = [t for t in under if len(t) == len(s) + 1]
        leaves = [t for t in under if not any(u[:len(t)] == t and len(u) > len(t) for u in under)]
        saved = sum((len(nodes[t]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", t[-1][1])) for t in under if t)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(s))))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def tried(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(tuple(r) for r in prefix_trie.trie(df, **sizes).select(TRIE).collect())


def conversations(seed, n=90):
    """Few different turns, so that prefixes are shared to any depth; negative ids, gaps, copies, null turns and texts."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-45, 400), n, replace=False).tolist():
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, ["user", "assistant", None][t % 2 if rng.random() < 0.95 else 2], ["a b", "c", None, "long  text\x0bhere", ""][int(rng.integers(0, 2 + (t > 2) * 3))]))
    return rows


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"most": 4, "bucket": 5}), (3, {"most": 1, "bucket": 1})])
def test_trie_is_that_of_brute_force(spark, seed, sizes):
    rows = conversations(seed)
    assert tried(spark, rows, **sizes) == brute_trie(rows)


def test_trie_of_copies_and_long_chains(spark):
    """Exact copies in thousands, two long conversations that part at the end, one that is the beginning of others."""
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 3000) for t in range(3)]
    rows += [(c, t, "user", f"deep {t} " + ("end" if t == 699 and c == 9980 else "")) for c in (5000, 9980) for t in range(700)]
    rows += [(7000, t, "user", f"deep {t} ") for t in range(350)]
    got = tried(spark, rows, most=2, bucket=3)
    root = got[0]
    copies = [c for c in range(1000, 3000)]
    assert root[:4] == (1000, 0, None, 2003) and root[5] == 3
    assert sum(r[3] == 2000 for r in got) == 3 and any(r[7] == hashlib.sha256(",".join(map(str, copies)).encode()).hexdigest() for r in got)
    assert len(got) == 1 + 3 + 700 + 1
    assert root[6] == 1999 * 6 + 350 * 2 * 2 + 349 * 1 * 2


def test_trie_cases(spark):
    assert tried(spark, []) == [] and tried(spark, [(None, 1, "user", "x")]) == []
    only = tried(spark, [(0, 0, "user", "one two"), (0, 0, "user", "one two")])
    assert only == brute_trie([(0, 0, "user", "one two"), (0, 0, "user", "one two")]) and [r[3] for r in only] == [1, 1, 1]
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert [r[:6] for r in tried(spark, [(gone, 5, "user", "x")])] == [(gone, 0, None, 1, 0, 1)]
    odd = spark.createDataFrame([(0, 1, None, None, 9), (20, None, "user", "w " * 100_000, 8)], "conv_id long, turn int, role string, text string, depth int")
    got = prefix_trie.trie(odd)
    assert got.columns == TRIE and got.count() == 3


def brute_white(vectors, k):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = [[Fraction(n * r[j] - sums[j], n) for j in range(d)] for r in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    values, unit = np.linalg.eigh(cov)
    values, unit = values[::-1][:k], unit[:, ::-1][:, :k]
    return [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x], np.array(centred, dtype=float) @ unit / np.sqrt(values), values / np.trace(cov), cov


def test_whitening_is_that_of_exact_arithmetic(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * [0.1, 1, 1, 5, 1, 20] + 3e5
    v[40:140] = v[7]
    rows = spark.createDataFrame([(k, x.tolist(), 1, 0.5) for k, x in enumerate(v)], "vec_id long, embedding array<double>, n int, whitened double").repartition(5)
    got = whitening.whitened(rows, 4).toPandas()
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got) == 1200
    deviation, white, share, _ = brute_white(v, 4)
    p = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((p * white).sum(axis=0))
    assert np.abs(p * sign - white).max() < 1e-8 and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == {k: d if d < 2**63 else None for k, d in enumerate(deviation)} or got["deviation"].isna().any()
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-9)


def test_small_components_beside_large_ones(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5)) * [0.5, 1, 1, 5, 1e6] + 1e4
    got = whitening.whitened(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")).toPandas()
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert white.shape == (400, 5) and got["identity_error"][0] < 1e-9 and np.abs(np.cov(white.T, bias=True) - np.eye(5)).max() < 1e-9


def test_pairs_hold_what_doubles_lose(spark):
    rng = np.random.default_rng(8)
    c = rng.standard_normal((5_000, 3)) * 2.0 ** rng.integers(-25, 25, (5_000, 1)), np.zeros((5_000, 3))
    hi, lo = whitening.outer(tuple(x[:whitening.BLOCK] for x in c))
    want = [[sum(Fraction(a) * Fraction(b) for a, b in zip(c[0][:whitening.BLOCK, i].tolist(), c[0][:whitening.BLOCK, j].tolist(), strict=True)) for j in range(3)] for i in range(3)]
    scale = max(abs(w) for row in want for w in row)
    assert all(abs(Fraction(hi[i, j]) + Fraction(lo[i, j]) - want[i][j]) < scale * Fraction(1, 2**58) for i in range(3) for j in range(3))
    hi, lo = whitening.column_sums((np.full((4096, 1), 2.0**45 + 1 / 64), np.zeros((4096, 1))))
    assert Fraction(hi[0]) + Fraction(lo[0]) == 4096 * (2**45 + Fraction(1, 64)) and hi[1] == 4096


def test_whitening_cases(spark):
    schema = "vec_id long, embedding array<float>"
    nothing = [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]]
    for rows in nothing:
        got = whitening.whitened(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns[0] == "vec_id"
    got = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25, 0.0]), (1, [0.5, 0.25, 0.0]), (None, [0.25, 0.5, 0.0]), (4, [1.0]), (6, None)], schema))
    assert got.count() == 3 and {r["vec_id"] for r in got.collect()} == {1, None} and got.first()["n"] == 3  # all on one line; the third entry never varies
    got = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.25, 0.75]), (5, [3e38, 0.0])], schema))
    assert got.count() == 3 and got.where("vec_id = 5 AND deviation IS NULL").count() == 1


def nearest_by_force(ids, x, asked, k):
    ids = np.array(ids)
    out = []
    for q in np.flatnonzero(asked):
        score = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def test_neighbours_are_found(spark, sf):
    """Recall of the registered query, with exact scores; and of vectors of all lengths."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rng = np.random.default_rng(3)
    uneven = rng.standard_normal((3_000, 24)) * rng.lognormal(0, 0.7, (3_000, 1))
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(uneven)], "vec_id long, embedding array<double>, rank int")
    for df, ids, x in [(queries.QUERIES["op13_neighbours"](spark, sf), e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)), (neighbours.nearest(frame, F.col("id") % 20 == 0), np.arange(3_000), uneven)]:
        got = {(r["query_id"], r["vec_id"]): r["score"] for r in df.collect()}
        want = nearest_by_force(ids, x, ids % 20 == 0, 20)
        assert len(got) == len(want)
        hits = [(q, v) in got for q, _, v, _ in want]
        assert np.mean(hits) >= 0.95
        assert all(abs(got[q, v] - s) < 1e-12 * max(1, abs(s)) for q, _, v, s in want if (q, v) in got)


def test_neighbours_of_copies(spark):
    """A third of all rows are one vector, another lies close by in two ids: ties go by id, the query's own id is left out."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[300:600] = x[300]
    x[700] = x[701]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[300:500], "vec_id long, embedding array<double>").repartition(7)
    got = [tuple(r) for r in neighbours.nearest(df, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    want = nearest_by_force(range(900), x, np.arange(900) % 20 == 0, 20)
    at = lambda rows, q: [r[:3] for r in rows if r[0] == q]
    for q in (300, 320, 580, 700):
        assert at(got, q)[:19 if q != 700 else 1] == at(want, q)[:19 if q != 700 else 1]
    assert [r[2] for r in at(got, 580)] == list(range(300, 320)) and len(got) == len(want)


def test_neighbours_cases(spark):
    schema = "vec_id long, embedding array<float>, score int"
    for rows in ([], [(0, None, 1), (20, [0.0, 0.0], 1)], [(1, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1)]):
        assert neighbours.nearest(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0).count() == 0
    rows = [(0, [1.0, 0.0], 1), (3, [0.5, 0.0], 1), (3, [0.5, 0.0], 2), (2, [-1.0, 0.5], 1), (None, [1.0, 0.0], 1), (5, [float("nan"), 0.0], 1), (6, [1.0, None], 1), (7, [1.0], 1), (8, [float("-inf"), 1.0], 1), (9, [], 1), (0, [2.0, 0.0], 1)]
    got = neighbours.nearest(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0).orderBy("score")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [tuple(r) for r in got.collect()] == [(0, 2, 2, -2.0), (0, 2, 2, -1.0), (0, 1, 3, 0.5), (0, 1, 3, 1.0)]


def test_trie_against_sql(spark):
    assert same(queries.QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), queries.SQL["op11_prefix_trie"]) == 391
