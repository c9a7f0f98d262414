"""Exact top-k by inner product with a vector-approximation file.

Every vector is turned into integers floor(256 x), and each component into one of
16 cells; the packed cell numbers are the approximation.  Inner cell edges are quantiles
of a bounded sample, the outer ones the least and largest component of all vectors, so
every vector is indexed.  The approximations are one table; the integers themselves
stand in files of records of fixed width beside it, read by place.  A query's bounds
on the inner product follow from the cells' edges alone.  One scan of the
approximations gives each query a score that its k-th best must reach; a second takes
the vectors whose upper bound reaches it, reads their records in the order of that
bound, and stops once the k-th score is above the next bound.

Queries go in blocks of a fixed number, each against all rows.  A vector that is
null or holds a null or non-finite component takes no part (nor one whose component
times 256 is beyond a double); nor does one against queries of another length.  Rows
with a null vec_id take no part.  Repeated rows count as separate candidates, except
that none of a query's own id are; each row with a query's id is a query of its own,
so a repeated id gives its ranks as often.  Components may have any size: bounds allow
for the rounding of doubles, and scores are exact integers, cut to the range of a long
only where they are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

CELLS = 16
QUERIES_AT_ONCE = 2048
SLICE = 2048
#: Rows a task indexes.
ROWS_EACH = 16_384
#: Rows, at most about twice as many, whose quantiles are the inner edges.
SAMPLE = 65_536


def integer_vectors(df: DataFrame, id_name: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, dim, v (array of whole doubles) of the rows that take part."""
    rows = pick(df, id_name, vector).select(F.col(id_name).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    # rounding down by parts of a double, since the floor function gives longs
    whole = lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(e).cast("double")).otherwise(e)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).select("vec_id", F.transform("x", lambda e: e * float(scale)).alias("x"))
    sound = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.filter(sound).select("vec_id", F.size("x").alias("dim"), F.transform("x", whole).alias("v"))


class Edges:
    """Ends of the cells of vectors of one length: a component in cell c lies in [low[d, c], high[d, c]]."""

    def __init__(self, lo: np.ndarray, inner: np.ndarray, hi: np.ndarray):
        self.inner = np.clip(inner, lo[:, None], hi[:, None])
        self.low = np.concatenate([lo[:, None], self.inner], axis=1)
        self.high = np.concatenate([self.inner - 1, hi[:, None]], axis=1)
        self.largest = np.maximum(np.abs(lo), np.abs(hi))

    def cells(self, v: np.ndarray) -> np.ndarray:
        if not v.shape[1]:
            return np.zeros(v.shape, np.uint8)
        return np.stack([np.searchsorted(self.inner[d], v[:, d], side="right") for d in range(v.shape[1])], axis=1).astype(np.uint8)


def cell_edges(rows: DataFrame, n: int) -> dict[int, Edges]:
    """The edges by number of components."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, v in _by_length(batch):
                lo, hi = v.min(axis=0), v.max(axis=0)
                a, b = known.get(dim, (lo, hi))
                known[dim] = (np.minimum(a, lo), np.maximum(b, hi))
        for dim, (lo, hi) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(lo), pa.array(hi)], ["dim", "at", "lo", "hi"])

    outer = rows.mapInArrow(ends, "dim int, at int, lo double, hi double").groupBy("dim", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    share = min(1.0, SAMPLE / max(n, 1))
    some = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("dim", F.posexplode("v").alias("at", "x"))
    inner = some.groupBy("dim", "at").agg(F.percentile_approx("x", F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), F.lit(1000)).alias("q"))
    by_dim: dict[int, list] = {}
    for r in outer.join(inner, ["dim", "at"], "left").collect():  # a row for each component
        by_dim.setdefault(r["dim"], []).append((r["at"], r["lo"], r["hi"], r["q"] or [r["lo"]] * (CELLS - 1)))
    out = {}
    for dim, found in by_dim.items():
        _, lo, hi, q = zip(*sorted(found), strict=True)
        out[dim] = Edges(np.array(lo), np.array(q), np.array(hi))
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, rows of the batch, their vectors) for vectors with any components."""
    dims, flat = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(dims) - dims
    for dim in np.unique(dims[dims > 0]).tolist():
        own = np.nonzero(dims == dim)[0]
        yield dim, own, flat[starts[own][:, None] + np.arange(dim)]


def index(rows: DataFrame, edges: dict[int, Edges], folder: str) -> DataFrame:
    """vec_id, dim, cells (a byte for two components), file, row: the approximations; writes the records they name.

    Each attempt of a task writes files of its own, named in its rows, so a task that
    runs again leaves no row without its record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            empty = ids[dims == 0]
            yield pa.RecordBatch.from_arrays([pa.array(empty), pa.array(np.zeros(len(empty), np.int32)), pa.array([b""] * len(empty), pa.binary()), pa.array([None] * len(empty), pa.string()), pa.array(np.zeros(len(empty), np.int32))], ["vec_id", "dim", "cells", "file", "row"])
            for dim, own, v in _by_length(batch):
                name = f"{uuid.uuid4().hex}.vec"
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(np.ascontiguousarray(v, "<f8").tobytes())
                cells = edges[dim].cells(v)
                if dim % 2:
                    cells = np.concatenate([cells, np.zeros((len(own), 1), np.uint8)], axis=1)
                packed = cells[:, ::2] | cells[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(dims[own].astype(np.int32)), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array([name] * len(own)), pa.array(np.arange(len(own), dtype=np.int32))], ["vec_id", "dim", "cells", "file", "row"])

    return rows.mapInArrow(run, "vec_id long, dim int, cells binary, file string, row int")


class Records:
    """Exact vectors by file and row, each read once in a task's slice."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.file, self.name = None, None

    def read(self, name: str, row: int, dim: int) -> np.ndarray:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.file, self.name = self.store.open_input_file(f"{self.root}/{name}"), name
        self.file.seek(8 * dim * row)
        return np.frombuffer(self.file.read(8 * dim), "<f8")


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole doubles as integers of any size."""
    most = float(np.abs(vectors).max(initial=0)), float(np.abs(query).max(initial=0))
    if max(most) < float(1 << 62) and most[0] * most[1] * max(len(query), 1) < float(1 << 62):
        return (vectors.astype(np.int64) @ query.astype(np.int64)).tolist()
    own = [int(x) for x in query]
    return [sum(int(a) * b for a, b in zip(v, own, strict=True)) for v in vectors]


class Block:
    """Queries of one length: their numbers, ids and vectors."""

    def __init__(self, numbers: list[int], ids: list[int], vectors: list[list[float]], edges: Edges | None):
        self.numbers, self.ids = np.array(numbers, np.int64), np.array(ids, np.int64)
        self.q = np.array(vectors, np.float64).reshape(len(ids), -1)
        self.edges = edges
        self.above, self.below = np.maximum(self.q, 0), np.minimum(self.q, 0)
        largest = edges.largest if edges is not None else np.zeros(0)
        # more than sums of products of doubles can be off
        with np.errstate(over="ignore"):
            self.slack = (np.abs(self.q) @ largest * (self.q.shape[1] + 2) * 2.0**-51)[:, None]

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) scores of (queries, vectors)."""
        if not self.q.shape[1]:
            return np.zeros((2, len(self.ids), len(cells)))
        low = np.take_along_axis(self.edges.low, cells.T.astype(np.int64), axis=1)
        high = np.take_along_axis(self.edges.high, cells.T.astype(np.int64), axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            least, most = self.above @ low + self.below @ high - self.slack, self.above @ high + self.below @ low + self.slack
        least[~np.isfinite(least)] = -np.inf  # beyond a double nothing is known
        most[~np.isfinite(most)] = np.inf
        return least, most


def under(score: int) -> float:
    """A double at most the score."""
    try:
        x = float(score)
    except OverflowError:
        return 1.7e308 if score > 0 else -math.inf
    return x - abs(x) * 2.0**-50


def _cells(column: pa.Array, dim: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    out = np.empty((len(column), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :dim]


def _slices(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block]) -> Iterator[tuple[Block, pa.RecordBatch]]:
    for batch in batches:
        dims = batch.column(1).to_numpy(zero_copy_only=False)
        for dim, block in blocks.items():
            own = np.nonzero(dims == dim)[0]
            for a in range(0, len(own), SLICE):
                yield block, batch.take(pa.array(own[a : a + SLICE]))


def _certain(table: DataFrame, shared, k: int) -> DataFrame:
    """number, floor: the k largest lower bounds of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = shared.value
        best = {d: np.full((len(b.ids), k), -np.inf) for d, b in blocks.items()}
        for block, part in _slices(batches, blocks):
            dim = block.q.shape[1]
            low, _ = block.bounds(_cells(part.column(2), dim))
            low[block.ids[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
            top = np.concatenate([best[dim], low], axis=1)
            best[dim] = -np.partition(-top, k - 1, axis=1)[:, :k]
        for d, block in blocks.items():
            found = np.isfinite(best[d])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.numbers, found.sum(axis=1))), pa.array(best[d][found])], ["number", "floor"])

    return table.select("vec_id", "dim", "cells").mapInArrow(run, "number long, floor double")


def _exact(table: DataFrame, shared, floors, k: int, folder: str) -> DataFrame:
    """number, query_id, vec_id, score (decimal text): of each partition, the k best of each query that can be among its k best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = shared.value
        records = Records(folder)
        need = {d: np.array([floors.value.get(int(i), -np.inf) for i in b.numbers]) for d, b in blocks.items()}
        best: dict[int, list[tuple[int, int]]] = {}
        names = {int(n): int(i) for b in blocks.values() for n, i in zip(b.numbers, b.ids, strict=True)}
        for block, part in _slices(batches, blocks):
            dim, ids = block.q.shape[1], part.column(0).to_numpy()
            _, high = block.bounds(_cells(part.column(2), dim))
            high[block.ids[:, None] == ids[None, :]] = -np.inf
            files, places = part.column(3).to_pylist(), part.column(4).to_pylist()
            seen: dict[int, np.ndarray] = {}
            for i in np.nonzero((high >= need[dim][:, None]).any(axis=1))[0].tolist():
                near = np.nonzero((high[i] >= need[dim][i]) & (high[i] > -np.inf))[0]
                near = near[np.argsort(-high[i, near], kind="stable")]
                number = int(block.numbers[i])
                own = best.setdefault(number, [])
                for at in range(0, len(near), 2 * k):  # exact vectors, in the order of their bounds
                    if len(own) >= k and high[i, near[at]] < under(-own[k - 1][0]):
                        break
                    some = near[at : at + 2 * k].tolist()
                    for j in some:
                        if j not in seen:
                            seen[j] = records.read(files[j], places[j], dim) if dim else np.zeros(0)
                    scores = exact_scores(np.stack([seen[j] for j in some]), block.q[i])
                    own = sorted(own + [(-s, int(ids[j])) for s, j in zip(scores, some, strict=True)])[:k]
                best[number] = own
                if len(own) >= k:
                    need[dim][i] = max(need[dim][i], under(-own[k - 1][0]))
        out = [(q, names[q], v, str(-s)) for q, own in best.items() for s, v in own]
        number, q, v, s = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.string())], ["number", "query_id", "vec_id", "score"])

    return table.mapInArrow(run, "number long, query_id long, vec_id long, score string")


def _order(score) -> list:
    """Columns that order decimal texts of whole numbers, largest first."""
    negative, size = F.startswith(score, F.lit("-")), F.length(score)
    return [negative, F.when(negative, size).otherwise(-size), F.when(negative, score), score.desc()]


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose id is divisible by ``every``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vector-file")
    whole = integer_vectors(df, id_name, vector)
    n = whole.count()
    edges = cell_edges(whole, n)
    # rows are dealt to as many tasks as they ask for
    table = scratch.table(index(whole.repartition(max(1, -(-n // ROWS_EACH))), edges, scratch.path("vectors")), "cells")
    # equal rows ask once; their ranks are repeated at the end
    asked = whole.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    queries = scratch.table(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = -(-queries.count() // QUERIES_AT_ONCE)
    order = Window.partitionBy("number")
    result = "number long, query_id long, vec_id long, score string, rank int"
    spark.createDataFrame([], result).write.parquet(scratch.path("found/block=-1"))
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).collect()  # about QUERIES_AT_ONCE rows
        lengths = sorted({len(r["v"]) for r in own})
        some = {d: [r for r in own if len(r["v"]) == d] for d in lengths}
        by_dim = {d: Block([r["number"] for r in some[d]], [r["vec_id"] for r in some[d]], [r["v"] for r in some[d]], edges.get(d)) for d in lengths}
        shared = spark.sparkContext.broadcast(by_dim)
        certain = _certain(table, shared, k).withColumn("at", F.row_number().over(order.orderBy(F.desc("floor")))).filter(F.col("at") <= k)
        floors = spark.sparkContext.broadcast({r["number"]: r["floor"] for r in certain.filter(F.col("at") == k).collect()})
        found = _exact(table, shared, floors, k, scratch.path("vectors"))
        ranked = found.withColumn("rank", F.row_number().over(order.orderBy(*_order(F.col("score")), "vec_id"))).filter(F.col("rank") <= k)
        ranked.select("number", "query_id", "vec_id", "score", "rank").write.parquet(scratch.path(f"found/block={b}"))
        shared.unpersist()
        floors.unpersist()
    scratch.drop("cells", "vectors")
    found = spark.read.schema(result + ", block int").parquet(scratch.path("found"))
    times = queries.filter("times > 1").select("number", "times")
    each = found.join(times, "number", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    wide = F.col("score").cast("decimal(38,0)")
    score = F.when(F.length("score") > 38, F.when(F.startswith("score", F.lit("-")), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))).otherwise(F.least(F.greatest(wide, F.lit(-(1 << 63)).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long"))
    return each.select("query_id", "rank", "vec_id", score.alias("score"))
