"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of 3 to 6 characters (code points; A-Z
lower-cased, white space as one blank), hashed to 2^20 places.  From labelled rows, a
place's ratio is log((p + 1) / (P + 2)) - log((n + 1) / (N + 2)), p of P toxic and n of
N other texts having it; a logistic regression with an L2 penalty is trained on the
ratios of the places a text has.  Half the weight of a feature is thus prior knowledge
of its class, which few labels suffice for.  A place takes part where its ratio is
``CERTAIN`` standard errors from 0 or more, whatever the number of labels.

Both are fitted on at most ``SAMPLE`` labelled rows, drawn by a hash of the id,
of those whose crc32(doc_id) mod 5 is not 0.  Rows of ``labels`` that are null or
doubled (the larger label counts) do no harm; without rows of both classes the
score is the share of toxic ones (0.5 without any).  A null text counts as empty
and gets the score of the intercept.  Every row gets its own result, equal texts
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, pick, remainder

BITS = 20
SIZES = (3, 4, 5, 6)
#: Most labelled rows that the classifier is fitted on.
SAMPLE = 6000
#: Standard errors that a place's ratio must be away from 0 to be trained on.
CERTAIN = 3.0
STEPS, RATE, PENALTY = 60, 0.03, 2e-4

_MULTIPLY = np.uint32(0x9E3779B1)


class Grams:
    """Places of a text's distinct n-grams, in no order."""

    def __init__(self):
        self.mark = np.zeros(1 << BITS, np.uint32)

    def __call__(self, text: bytes) -> np.ndarray:
        plain = (b" " + b" ".join(text.lower().split()) + b" ").decode("utf-8", "replace")
        data = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
        out, h = [], data
        for n in range(2, SIZES[-1] + 1):
            if len(data) < n:
                break
            h = (h[:-1] * _MULTIPLY) ^ ((data[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B))
            if n in SIZES:
                out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
        if not out:
            return np.zeros(0, np.uint32)
        at = np.concatenate(out)
        own = np.arange(len(at), dtype=np.uint32)
        self.mark[at] = own  # the last of equal places stands
        return at[self.mark[at] == own]


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, places: np.ndarray) -> float:
        z = float(self.weights[places].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ratios(p: np.ndarray, n: np.ndarray, toxic: int, others: int, certain: float = CERTAIN) -> np.ndarray:
    """Scaled log-count ratios from the numbers of toxic and other texts with each place; 0 where too little is known."""
    ratio = np.log((p + 1) / (toxic + 2)) - np.log((n + 1) / (others + 2))
    keep = np.abs(ratio) >= certain * np.sqrt(1 / (p + 1) + 1 / (n + 1))
    ratio[~keep] = 0
    return ratio * np.sqrt(1 / np.mean(ratio[keep] ** 2)) if keep.any() else ratio


def counted(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of toxic and of other texts with each place."""
    p, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for places, label in zip(rows, labels, strict=True):
        (p if label else n)[places] += 1
    return p, n


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The classifier from the places of each text and its label."""
    ratio = ratios(*counted(rows, labels), int(labels.sum()), int((1 - labels).sum()))
    return regress([r[ratio[r] != 0] for r in rows], labels, ratio)


def regress(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression on the ratios of each text's places."""
    y = labels.astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    # only the places that are trained on get a weight
    used = np.nonzero(ratio)[0]
    number = np.zeros(1 << BITS, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    own, k = ratio[used], len(used)
    weight, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    some = np.array([i for i, r in enumerate(rows) if len(r)], np.int64)
    sizes = np.array([len(rows[i]) for i in some], np.int64)
    flat = number[np.concatenate([rows[i] for i in some])] if len(some) else np.zeros(0, np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    # texts in stretches of bounded length
    cuts = np.searchsorted(starts, np.arange(1 << 20, len(flat) + (1 << 20), 1 << 20))
    bounds = sorted({0, *np.minimum(cuts, len(some)).tolist(), len(some)})
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, STEPS + 1):
        scaled, score = weight * own, np.full(len(rows), b)
        grad = np.zeros(k)
        for c, d in zip(bounds[:-1], bounds[1:], strict=True):
            part = flat[starts[c] : starts[d]]
            score[some[c:d]] += np.add.reduceat(scaled[part], starts[c:d] - starts[c])
        g = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        for c, d in zip(bounds[:-1], bounds[1:], strict=True):
            grad += np.bincount(flat[starts[c] : starts[d]], np.repeat(g[some[c:d]], sizes[c:d]), k)
        grad, gb = grad * own / len(rows) + PENALTY * weight, g.sum() / len(rows)
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = RATE * min(1.0, 2.5 * (1 - t / (STEPS + 1)))
        weight -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = weight * own
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fifth."""
    wanted = pick(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder("doc_id", 5) != 0))
    wanted = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                places = [grams(t or b"").tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(places, pa.binary())], ["doc_id", "toxic", "places"])

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # at most ``sample`` rows of two numbers are broadcast; the texts stay where they are
    found = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "toxic", "text")
    scratch = Scratch(docs.sparkSession, "toxicity")
    # the sample's places stay in a table; only counts, and the places that are trained on, come to the driver
    table = scratch.table(found.mapInArrow(run, "doc_id long, toxic int, places binary"), "places")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            a, b = counted([np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()], batch.column(1).to_pylist())
            p += a
            n += b
        at = np.nonzero(p + n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(p[at]), pa.array(n[at])], ["place", "p", "n"])

    sums = table.mapInArrow(count, "place int, p long, n long").groupBy("place").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = sums.filter(F.col("p") + F.col("n") > 0).toArrow()
    p, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    p[sums.column("place").to_numpy()], n[sums.column("place").to_numpy()] = sums.column("p").to_numpy(), sums.column("n").to_numpy()
    of = {r["toxic"]: r["count"] for r in table.groupBy("toxic").count().collect()}  # two rows
    ratio = ratios(p, n, of.get(1, 0), of.get(0, 0))
    del sums, p, n
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(ratio != 0))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(known.value).astype(bool)
        for batch in batches:
            places = [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[own[x]].tobytes() for x in places], pa.binary())], ["doc_id", "toxic", "places"])

    used = table.mapInArrow(keep, "doc_id long, toxic int, places binary").orderBy("doc_id", "places").toArrow()
    scratch.drop("places")
    rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in used.column("places")]  # views, not copies
    return regress(rows, np.array(used.column("toxic").to_pylist(), np.int64), ratio)


def scores(docs: DataFrame, model: Model, columns: list[str], score: str) -> DataFrame:
    """The named columns and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (text,) = free_names(docs, "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("`text`").cast("binary").alias(text))
    schema = rows.drop(text).withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(), shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # few texts at once
                part = batch.slice(a, 256)
                found = [model.score(grams(t or b"")) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.float64())], [*part.schema.names[:-1], score])

    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scores(pick(docs, "doc_id", "text"), train(docs, labels), ["doc_id"], "score")
    held = remainder("doc_id", 5) == 0
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below 0.5, as they came."""
    (score,) = free_names(docs, "_score")
    out = scores(docs, train(docs, labels), docs.columns, score)
    return out.filter(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
