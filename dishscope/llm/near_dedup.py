"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct shingles of k words (A-Z lower-cased; the
whole sequence where it has fewer words).  Equal sets form one class.  Each class
has 128 MinHash values, and 32 trees order the classes by different stretches of
them.  In each tree, classes that agree on the first four values are a region.  The
order goes on for eight more values, of which a region uses as many as its size asks
for: it is cut at growing depth until a part holds few classes, and these are all
candidates; besides, every class meets its neighbours in the order, which have the
longest common prefixes, and in a large region the region's pivot, the class that
shares most regions with others (the text that edited copies come from).  No region
gives pairs of all with all.

Candidates are confirmed on the full sets: first each class's likeliest partner;
then, of the others, those still in different components.  Last, where a large
region still holds several components, an exact join finds what neighbours and pivots
missed: classes apart from the pivot meet the classes of those regions that share
one of their rarest shingles, are in another component, and can reach the similarity
by size and place.  So a family that is one component by then gives no rows there.  At
a similarity of 0.8 a pair misses the first four values in all 32 trees with
probability (1 - 0.8^4)^32 = 5e-8.

Null texts and texts without words have no shingles, are linked with nothing and
stay.  Rows with a null doc_id take part in links but never name a component
unless all of its rows lack an id.  Repeated rows fall in one class; of rows equal in
id and text the first in the input's order stays.  The input is read twice and must
be a scan, a written table or cached rows, so that rows keep their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, pick, small
from .components import components

TREES, FIRST, DEEPER = 32, 4, 8
HASHES = TREES * FIRST
NEIGHBOURS = 4
#: Classes of a part of a region whose pairs are all candidates.
TOGETHER = 8
#: Rows of a region, or pairs of a class, that a join takes under one key.
SPLIT = 512
#: Bits of the filter for texts to read again; a fuller filter only lets more texts pass.
FILTER_BITS = 1 << 24
WORDS_REMEMBERED = 300_000

_rng = np.random.Generator(np.random.PCG64(20240131))
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text in UTF-8."""

    def __init__(self, k: int):
        self.k = k
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        kept = self.kept
        if len(kept) > WORDS_REMEMBERED:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxh3_64_intdigest(w)
        h = np.array([kept[w] for w in words], np.uint64)
        n = min(self.k, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out + h[i : len(h) - n + 1 + i]) * _STEP
            out ^= out >> np.uint64(29)
        return np.unique(_mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    """128 minima, each as a 16-bit number: equal minima agree, others once in 65,536."""
    low = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(s), 512):
        np.minimum(low, ((s[a : a + 512] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def _rows(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return numbered(rows, "row").select("doc_id", "row", "text")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row, n, class_key, signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingles = Shingler(k)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n, keys, signs = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text or b"")
                    n.append(len(s))
                    keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signs.append(signature(s).astype(">u2").tobytes() if len(s) else None)
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "class_key", "signature"])

    return _rows(docs).mapInArrow(run, "doc_id long, row long, n long, class_key binary, signature binary")


def shingle_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """node, shingles of the rows in ``wanted`` (row, node); a bit filter of fixed size spares most other texts."""
    spark = docs.sparkSession
    bit = lambda row: F.pmod(F.xxhash64(row), F.lit(FILTER_BITS))
    words = wanted.select((bit("row") / 32).cast("int").alias("w"), F.pow(F.lit(2), bit("row") % 32).cast("long").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)  # at most one row a word: the size is fixed
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint32)
        shingles = Shingler(k)
        for batch in batches:
            at = batch.column(3).to_numpy(zero_copy_only=False)
            hit = np.nonzero(bits[at >> 5] >> (at & 31).astype(np.uint32) & 1)[0]
            for a in range(0, len(hit), 256):
                some = batch.take(pa.array(hit[a : a + 256]))
                sets = [shingles(t or b"").view(np.int64) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(1), pa.array(sets, pa.list_(pa.int64()))], ["row", "shingles"])

    found = _rows(docs).withColumn("bit", bit("row")).mapInArrow(run, "row long, shingles array<long>")
    return found.join(wanted, "row").select("node", "shingles")


def forest(nodes: DataFrame) -> DataFrame:
    """(region, deeper, node, n): a row per class and tree; ``deeper`` orders the classes of a region."""
    twice = F.concat("signature", F.substring("signature", 1, 2 * DEEPER))
    at = lambda t, first, size: F.substring(twice, t * 2 * FIRST + 2 * first + 1, F.lit(2 * size))
    tree = lambda t: F.struct(F.xxhash64(t, at(t, 0, FIRST)).alias("region"), at(t, FIRST, DEEPER).alias("deeper"))
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), tree)
    return nodes.select("node", "n", F.explode(trees).alias("x")).select("x.region", "x.deeper", "node", "n")


def alike_in_size(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity."""
    return den * np.minimum(a, b) >= num * np.maximum(a, b)


def candidates(region: np.ndarray, deeper: np.ndarray, node: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """(2, pairs) of classes in order: neighbours in a region, and all of each part small enough at the region's own depth."""
    m, out = len(node), [np.zeros((2, 0), np.int64)]
    if m < 2:
        return out[0]
    together = region[:-1] == region[1:]
    part, open_ = np.concatenate([[0], np.cumsum(~together)]), np.ones(m, bool)
    whole = part
    for depth in range(0, DEEPER + 1, 2):
        if depth:
            together = together & (deeper[:-1, depth - 2 : depth] == deeper[1:, depth - 2 : depth]).all(axis=1)
            part = np.concatenate([[0], np.cumsum(~together)])
        few = (np.bincount(part)[part] <= TOGETHER) & open_
        for j in range(NEIGHBOURS + 1, TOGETHER):
            i = np.nonzero(few[: m - j] & (part[: m - j] == part[j:]))[0]
            out.append(np.stack([i, i + j]))
        open_ &= ~few
    for j in range(1, min(NEIGHBOURS, m - 1) + 1):
        i = np.nonzero(whole[:-j] == whole[j:])[0]
        out.append(np.stack([i, i + j]))
    a, b = np.concatenate(out, axis=1)
    fits = alike_in_size(n[a], n[b], num, den)
    return np.stack([node[a[fits]], node[b[fits]]])


def neighbour_pairs(regions: DataFrame, parts: int, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(a, b) of classes near one another in the order of some tree and in one region of it."""
    names = ["kind", "part", "place", "region", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows(kind: int, place: np.ndarray, region: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            fill = lambda v: pa.array(np.full(len(a), v, np.int32))
            return pa.RecordBatch.from_arrays([fill(kind), fill(part), pa.array(place.astype(np.int64)), pa.array(region), pa.array(a), pa.array(b)], names)

        kept, seen, held = TOGETHER, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            region, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            deep = batch.column(1)
            deeper = np.frombuffer(deep.buffers()[2], ">u2", len(deep) * DEEPER, deep.offset * 2 * DEEPER).reshape(-1, DEEPER)
            if held is None:  # the first rows meet the last of the parts before
                yield rows(1, np.arange(min(kept, len(node))), region[:kept], node[:kept], n[:kept])
            else:
                region, deeper, node, n = (np.concatenate(x) for x in zip(held, (region, deeper, node, n), strict=True))
            pairs = candidates(region, deeper, node, n, num, den)
            zero = np.zeros(pairs.shape[1], np.int64)
            yield rows(0, zero, zero, pairs[0], pairs[1])
            seen += batch.num_rows
            held = region[-kept:], deeper[-kept:], node[-kept:], n[-kept:]
        if held is not None and seen > kept:
            own = max(0, 2 * kept - seen)  # those that the first rows do not hold
            region, _, node, n = (x[own:] for x in held)
            yield rows(1, seen - len(node) + np.arange(len(node)), region, node, n)

    order = ["region", "deeper", "node"]
    ordered = regions.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("region", "deeper", "node", "n")
    found = scratch.table(ordered.mapInArrow(run, "kind int, part int, place long, region long, a long, b long"), "neighbours")
    # a region that spans parts has few rows in each part's ends; those not beside one another are pairs too many
    w = Window.partitionBy("region").orderBy("part", "place")
    ends = found.filter("kind = 1").select("region", F.col("a").alias("node"), F.col("b").alias("n"), "part", "place")
    after = F.array(*[F.struct(F.lead("node", j).over(w).alias("b"), F.lead("n", j).over(w).alias("m")) for j in range(1, NEIGHBOURS + 1)])
    ends = ends.select(F.col("node").alias("a"), "n", after.alias("after")).select("a", "n", F.explode("after").alias("x")).filter("x.b is not null")
    ends = ends.filter(den * F.least("n", "x.m") >= num * F.greatest("n", "x.m")).select("a", "x.b")
    return found.filter("kind = 0").select("a", "b").unionByName(ends)


def large_members(regions: DataFrame, scratch: Scratch) -> DataFrame:
    """region, node, n, m of the regions with more classes (m) than a neighbourhood."""
    large = regions.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > NEIGHBOURS + 1)
    large = scratch.table(large, "large")
    return regions.select("region", "node", "n").join(small(large, large.count()), "region")


def pivot_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, fits): each class of a large region with the region's most connected class; whether their sizes let them be alike."""
    known = members.groupBy("node").agg(F.sum("m").alias("fame"))
    best = F.max(F.struct("fame", F.col("node").alias("p"), F.col("n").alias("pn"))).alias("best")
    pivots = members.select("region", "m", "node", "n").join(known, "node").groupBy("region", "m").agg(best)
    # a region's rows are taken under as many keys as its size asks for
    pieces = F.ceil(F.col("m") / SPLIT).cast("int")
    pivots = pivots.select("region", "best.p", "best.pn", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    asked = members.withColumn("piece", F.pmod(F.xxhash64("node"), pieces).cast("int"))
    fits = den * F.least("n", "pn") >= num * F.greatest("n", "pn")
    met = asked.join(pivots, ["region", "piece"]).filter(F.col("node") != F.col("p"))
    return met.select(F.col("node").alias("a"), F.col("p").alias("b"), fits.alias("fits"))


def prefix_pairs(sets: DataFrame, classes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of ``classes`` (node, component, asked) in different components, one of them asked, that can reach the similarity.

    In the order of rarity, two such sets share a shingle among the first
    n - ceil(n * num / den) + 1 of both, and among the first n - 2 n num / (num + den)
    of the smaller one.  From the place of that shingle in both follows how much
    they can share at most.  Edits leave rare shingles, so copies edited in different
    places meet in few lists or at places too late; lists of one component are left out.
    """
    tokens = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    often = scratch.table(tokens.groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often")
    often = small(often, often.count())
    rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s"))).alias("all")
    ranked = tokens.join(often, "s", "left").groupBy("node", "n").agg(rarity)
    length = (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int")
    prefixes = ranked.select("node", "n", F.posexplode(F.slice("all", F.lit(1), length)).alias("at", "x")).filter("x.f > 1")
    prefixes = prefixes.select("node", "n", "at", F.col("x.s").alias("s")).join(classes, "node")
    prefixes = scratch.table(prefixes, "prefixes")
    mixed = prefixes.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("asked").alias("asked"))
    mixed = scratch.table(mixed.filter("asked and lo <> hi").select("s"), "mixed")
    mixed = small(mixed, mixed.count())
    live = scratch.table(prefixes.join(mixed, "s", "left_semi"), "lists")
    early = (den + num) * (F.col("n") - F.col("at")) >= 2 * num * F.col("n")
    side = lambda p: [F.col(c).alias(f"{c}_{p}") for c in ("node", "n", "at", "component", "asked")]
    more, less = live.select("s", *side("x")), live.filter(early).select("s", *side("y"))
    smaller = F.struct("n_y", "node_y") < F.struct("n_x", "node_x")
    most = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    can = (den + num) * most >= num * (F.col("n_x") + F.col("n_y"))
    met = more.join(less, "s").filter(smaller & (F.col("component_x") != F.col("component_y")) & (F.col("asked_x") | F.col("asked_y")) & can)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets have den * |intersection| >= num * |union|; a class may be in many pairs."""
    busy = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("pieces")).filter("pieces > 1")
    busy = scratch.table(busy, f"busy-{name}")
    busy = small(busy, busy.count())
    pieces = F.coalesce("pieces", F.lit(1))
    asked = pairs.join(busy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), pieces).cast("int").alias("piece"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(busy, "b", "left")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    both = asked.join(left, "a").join(right, ["b", "piece"])
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    both = both.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("s"), shared.alias("i"))
    return scratch.table(both.filter(den * F.col("i") >= num * (F.col("s") - F.col("i"))).select("a", "b"), name)


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are in different components of ``found`` (node, component); others are alone."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def ordered_pair(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def class_links(docs: DataFrame, k: int, nodes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(node, component) of all classes that are linked, from nodes (node, row, n, signature)."""
    spark = docs.sparkSession
    regions = forest(nodes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * TREES // 500_000))
    members = scratch.table(large_members(regions, scratch), "members")
    pivots = scratch.table(pivot_pairs(members, num, den), "pivots")
    near = neighbour_pairs(regions, parts, scratch, num, den).unionByName(pivots.filter("fits").select("a", "b"))
    near = scratch.table(ordered_pair(near).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")), "pairs")
    scratch.drop("neighbours")

    # first each class's likeliest partner: the one met most often, in most trees or as the pivot of most regions
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "times"))
    first = both.groupBy("a").agg(F.max(F.struct("times", "b")).alias("best")).select("a", "best.b")
    once = first.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("a", "b")).alias("p"))
    first = scratch.table(once.select("p.a", "p.b"), "first")
    involved = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    sets = scratch.table(shingle_sets(docs, k, scratch.table(nodes.select("row", "node").join(involved, "node", "left_semi"), "involved")), "sets")
    links = confirmed(first, sets, num, den, scratch, "links1")
    found = scratch.table(components(links, scratch, "one"), "found1")

    # then all other candidates between different components
    tried = ordered_pair(first)
    rest = scratch.table(apart(near.select("a", "b"), found).join(tried, ["a", "b"], "left_anti"), "rest")
    more = confirmed(rest, sets, num, den, scratch, "links2")
    found = scratch.table(components(links.unionByName(more), scratch, "two"), "found2")

    # last all partners of the classes that are still apart from a large region's pivot, alike in size to it or not
    away = scratch.table(apart(pivots.select("a", "b").distinct(), found).select(F.col("a").alias("node")).distinct(), "away")
    live = members.join(members.join(away, "node", "left_semi").select("region").distinct(), "region", "left_semi").select("node").distinct()
    asked = live.join(found, "node", "left").join(away.withColumn("asked", F.lit(True)), "node", "left")
    asked = asked.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("asked", F.lit(False)).alias("asked"))
    asked = scratch.table(asked, "asked")
    partners = prefix_pairs(sets.join(asked, "node", "left_semi"), asked, num, den, scratch)
    partners = scratch.table(partners.join(near.select("a", "b"), ["a", "b"], "left_anti"), "partners")
    last = confirmed(partners, sets, num, den, scratch, "links3")
    return scratch.table(components(links.unionByName(more).unionByName(last), scratch, "three"), "found3")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept, stays of every document.

    ``row`` is the document's number in the scan.  ``kept`` is doc_id = component_id;
    ``stays`` marks the one row of each component to keep.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = scratch.table(sketches(docs, k), "sketches")
    named = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")
    classes = rows.filter("n > 0").groupBy("class_key").agg(F.min("doc_id").alias("least"), F.min(named).alias("best"))
    classes = scratch.table(classes.select("class_key", "least", "best", F.col("best.row").alias("node")), "classes")
    nodes = rows.select(F.col("row").alias("node"), "n", "signature").join(classes.select("node"), "node")
    nodes = scratch.table(nodes.select("node", F.col("node").alias("row"), "n", "signature"), "nodes")
    joined = class_links(docs, k, nodes, num, den, scratch)

    named = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("best").alias("first"))
    named = named.join(names, "component").select("class_key", "component_id", F.col("first.row").alias("first"))
    out = rows.select("doc_id", "row", "n", "class_key").join(named, "class_key", "left")
    alone = F.col("n") == 0
    component: Column = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    out = out.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), (alone | (F.col("row") == F.col("first"))).alias("stays"))
    out = scratch.table(out, "out")
    scratch.clear(keep=["out"])
    return out
