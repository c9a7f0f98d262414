"""Near duplicates at a larger size: large families side by side, chains across empty parts, rows linear in the input."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishscope.llm import near_dedup


def brute(rows, k=4, num=80, den=100):
    """doc_id -> least id reachable, from a matrix of shingles."""
    sets, number = [], {}
    for _, t in rows:
        w = t.split()
        sets.append({number.setdefault(tuple(w[i : i + k]), len(number)) for i in range(max(1, len(w) - k + 1))})
    n = len(rows)
    m = np.zeros((n, len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, list(s)] = 1
    size = m.sum(axis=1)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(0, n, 500):
        shared = np.rint(m[a : a + 500] @ m.T)
        i, j = np.nonzero(den * shared >= num * (size[a : a + 500, None] + size[None, :] - shared))
        for x, y in zip((i + a).tolist(), j.tolist(), strict=True):
            root[find(x)] = find(y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def family(rng, first, n, edits, length=45, words=4000):
    core = [f"w{rng.randint(0, words)}" for _ in range(length)]
    rows = [(first, " ".join(core))]
    for i in range(1, n):
        w = list(core)
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(length)] = f"e{first}x{rng.randint(0, 10**6)}"
        rows.append((first + i, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = family(rng, 10_000, 700, (0, 2)) + family(rng, 20_000, 1000, (1, 2)) + family(rng, 30_000, 500, (2, 4))
    for i in range(500):
        out.append((i, " ".join(f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(5, 60)))))
    for i in range(150):  # pairs of short edits of the single ones
        w = out[-500 + i][1].split()
        w[rng.randrange(len(w))] = "other"
        out.append((40_000 + i, " ".join(w)))
    return out


def test_families_against_brute_force(spark, rows, monkeypatch):
    made = {}
    plain = near_dedup.prefix_pairs

    def counting(sets, classes, *more):
        pairs = plain(sets, classes, *more).cache()
        made["pairs"], made["classes"] = pairs.count(), classes.count()
        return pairs

    monkeypatch.setattr(near_dedup, "prefix_pairs", counting)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache(), k=4).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < 0.7 * len(rows)
    # the exact join's rows follow the classes it is asked for, not their square
    assert made["pairs"] < 30 * max(made["classes"], 1)


def test_rows_that_span_many_parts(spark):
    """Neighbours are found across parts, also where parts between them are empty or hold a row."""
    rng = np.random.default_rng(2)
    regions = [(7, bytes([0, k]) * near_dedup.DEEPER, k, 50) for k in range(40)] + [(int(rng.integers(8, 99)), bytes(rng.integers(0, 9, 16).tolist()), 100 + k, 50) for k in range(20)]
    df = spark.createDataFrame(regions, "region long, deeper binary, node long, n long")
    scratch = near_dedup.Scratch(spark, "test")
    got = {(r.a, r.b) for r in near_dedup.neighbour_pairs(df, 60, scratch, 80, 100).collect()}
    got |= {(b, a) for a, b in got}
    assert all((k, k + j) in got for k in range(40) for j in range(1, near_dedup.NEIGHBOURS + 1) if k + j < 40)


def test_depth_of_a_region_follows_its_size():
    deeper = np.zeros((30, near_dedup.DEEPER), np.uint16)
    deeper[:, 0] = np.arange(30) // 6  # five parts of six: few enough at the next depth
    region, node, n = np.zeros(30, np.int64), np.arange(30), np.full(30, 10)
    pairs = {tuple(p) for p in near_dedup.candidates(region, deeper, node, n, 80, 100).T.tolist()}
    assert all((a, b) in pairs for a in range(30) for b in range(a + 1, 30) if a // 6 == b // 6)
    assert len(pairs) < 30 * (near_dedup.NEIGHBOURS + 2)
    sizes = np.where(np.arange(30) % 2, 10, 20)  # sets of too unequal size are no pairs
    assert all((a - b) % 2 == 0 for a, b in near_dedup.candidates(region, deeper, node, sizes, 80, 100).T.tolist())


def test_busy_classes_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT", 5)
    scratch = near_dedup.Scratch(spark, "test")
    sets = spark.createDataFrame([(i, list(range(20)) if i % 2 else list(range(10, 30))) for i in range(60)], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(i, 1) for i in range(2, 60)], "a long, b long")
    got = near_dedup.confirmed(pairs, sets, 80, 100, scratch, "links").collect()
    assert collections.Counter((r.a, r.b) for r in got) == collections.Counter((i, 1) for i in range(3, 60, 2))
    members = spark.createDataFrame([(1, i, 50 + i % 3, 40) for i in range(40)] + [(2, 7, 51, 6), (2, 70, 51, 6)], "region long, node long, n long, m long")
    made = near_dedup.pivot_pairs(members, 80, 100).filter("b = 7").select("a").collect()
    assert sorted(r.a for r in made) == sorted([*(i for i in range(40) if i != 7), 70])
    assert members.filter(F.col("node") == 7).count() == 2
