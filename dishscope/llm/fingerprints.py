"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases level by level.  At each level runs of one
name become one name; deterministic coin tossing then gives each name a small
label from itself and a few names before it, and phrases start where labels have
a local maximum.  A phrase's name is a hash of the names in it.  What a place is
parsed to depends only on a few phrases around it, so equal substrings have equal
phrases but for their ends, wherever they stand.

A fingerprint is the ``KEPT`` least 32-bit hashes of the distinct phrase names of the
second level and above, in hex; the likeness of two estimates the share of names
in both among the names in either, with a standard error of sqrt(p (1 - p) / KEPT), at
most 0.045.  ``phrase_names`` gives all names of a text, whose share is exact (``kept`` of 0
keeps them all here, too).  An empty text has an empty fingerprint; two empty ones have
likeness 1, an empty and another 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, range_partition, tie_of

#: Least hashes in a fingerprint; a parameter of the operators.
KEPT = 128
#: Bytes parsed at once; longer texts go alone.
TOGETHER = 1 << 18
#: Parts whose first rows (two numbers each) are broadcast; beyond that Spark picks the join.
MOST_BROADCAST = 1 << 21

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


def _toss(size: int) -> np.ndarray:
    """Labels of all pairs (before, name) of names below ``size``: place and value of the lowest bit they differ in."""
    x = np.arange(size, dtype=np.uint32)
    d = x[:, None] ^ x[None, :]
    d[d == 0] = 1  # stands for a name without one before it
    low = d & (~d + np.uint32(1))
    return (2 * np.bitwise_count(low - np.uint32(1)) + ((x[None, :] & low) > 0)).astype(np.uint8)


_AGAIN = [(t.shape[0], t.ravel()) for t in (_toss(128), _toss(16), _toss(8))]
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names (uint64) of several texts in a row, ``first`` marking where each begins."""
    if len(x) == 0:
        return x, first
    again = np.zeros(len(x), bool)
    again[1:] = (x[1:] == x[:-1]) & ~first[1:]
    if again.any():
        head = np.nonzero(~again)[0]
        length = np.diff(np.append(head, len(x))).astype(np.uint64)
        x, first = x[head], first[head]
        runs = np.nonzero(length > 1)[0]
        x[runs] = _mix(x[runs] ^ (length[runs] * _U(0xC2B2AE3D27D4EB4F)))
    d = np.empty_like(x)
    d[0] = _U(1)
    np.bitwise_xor(x[1:], x[:-1], out=d[1:])
    d[first] = _U(1)
    d[d == 0] = _U(1)
    low = d & (~d + _U(1))
    label = (np.bitwise_count(low - _U(1)) << np.uint8(1)) | ((x & low) != 0)
    at_first = np.nonzero(first)[0]
    for size, table in _AGAIN:
        pair = label.astype(np.uint16)
        pair[1:] += label[:-1].astype(np.uint16) * np.uint16(size)
        pair[at_first] = label[at_first].astype(np.uint16) * np.uint16(size + 1)
        label = table[pair]
    start = first.copy()
    rise = label[1:] > label[:-1]
    fall = np.ones(len(x), bool)
    fall[:-1] = (label[:-1] > label[1:]) | first[1:]
    start[1:] |= rise & fall[1:]
    at = np.nonzero(start)[0]
    length = np.diff(np.append(at, len(x)))
    place = (np.arange(len(x)) - np.repeat(at, length)).astype(np.uint64)
    name = np.add.reduceat(_mix(x + place * _U(0x9E3779B97F4A7C15)), at)
    return _mix(name + length.astype(np.uint64)), first[at]


def names(texts: list[bytes]) -> list[np.ndarray]:
    """32-bit hashes, unordered and not distinct, of each text's phrase names from the second level up."""
    sizes = np.array([len(t) for t in texts])
    own = np.nonzero(sizes)[0]
    if not len(own):
        return [np.zeros(0, np.uint32)] * len(texts)
    x = _BYTES[np.frombuffer(b"".join(texts), np.uint8)]
    first = np.zeros(len(x), bool)
    first[np.concatenate([[0], np.cumsum(sizes[own])[:-1]])] = True
    found: list[list[np.ndarray]] = [[] for _ in texts]
    level = 0
    while True:
        x, first = phrases(x, first)
        level += 1
        if level > 1:
            parts = np.split((x >> _U(32)).astype(np.uint32), np.nonzero(first)[0][1:])
            done = [len(p) == 1 for p in parts]
            for i, p in zip(own, parts, strict=True):
                found[i].append(p)
            if all(done):
                break
            if any(done):  # texts that are one phrase go no further
                size = np.array([len(p) for p in parts])
                keep = np.repeat(~np.array(done), size)
                x, first, own = x[keep], first[keep], own[~np.array(done)]
    return [np.concatenate(f) if f else np.zeros(0, np.uint32) for f in found]


def sketches(texts: list[bytes], kept: int = KEPT) -> list[np.ndarray]:
    """The ``kept`` least hashes of each text (all, where it is 0), ascending."""
    out: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= TOGETHER):
            size += len(texts[b])
            b += 1
        out += [np.unique(n)[: kept or None] for n in names(texts[a:b])]
        a = b
    return out


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.append(True, ~twice)
    # of the least distinct hashes of the two together, those that are in both
    n = min(kept or len(both), int(distinct.sum()))
    rank = np.cumsum(distinct)
    return float((twice & (rank[1:] <= n)).sum() / n)


def to_text(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def fingerprints(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """doc_id, fingerprint of every document (null texts count as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [to_text(s) for s in sketches([t or b"" for t in part.column(1).to_pylist()], kept)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return _texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def phrase_names(docs: DataFrame) -> DataFrame:
    """doc_id, names: the hashes of all distinct phrase names of every document, ascending; none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [s.astype(np.int64) for s in sketches([t or b"" for t in part.column(1).to_pylist()], 0)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "names"])

    return _texts(docs).mapInArrow(run, "doc_id long, names array<long>")


def edited_pairs(docs: DataFrame, docs_per_part: int = 8192, kept: int = KEPT) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half is the start of the next document.

    Order: descending doc_id, nulls last, equal ids by text; the first follows the
    last.  Parts of this order are parsed by one task each, with a copy of the row
    that follows the part, so texts are shuffled once.  The rows of an id that fills
    more than a part stand in parts by a hash of their texts, in each by text.  Rows are
    numbered by their place in the scan, so the input must be files, a written table or
    cached rows.
    """
    import hashlib

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    placed, parts = range_partition(rows, "doc_id", docs_per_part, tie_of(F.col("text")))
    # the first row of each part: the least text of its largest id
    scratch = Scratch(docs.sparkSession, "fingerprints")
    top = placed.groupBy("__part").agg(F.max("doc_id").alias("top"))
    top = F.broadcast(top) if parts <= MOST_BROADCAST else top
    first = placed.join(top, "__part").filter(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("__part").agg(F.min_by("rid", "text").alias("rid"))
    first = scratch.table(first, "first")  # a row a part
    ends = first.agg(F.min("__part"), F.max("__part")).first()
    # it is needed once more, at the end of the part above; the highest part's at the end of the lowest
    above = F.coalesce(F.lead("__part").over(Window.orderBy("__part")), F.lit(ends[0])).cast("int")
    copies = first.select("rid", above.alias("__for"))
    copies = F.broadcast(copies) if parts <= MOST_BROADCAST else copies
    placed = placed.join(copies, "rid", "left")
    one = lambda part, copy: F.struct(part.alias("part"), F.lit(copy).alias("copy"))
    own = one(F.col("__part"), 0)
    placed = placed.select("doc_id", "text", F.explode(F.when(F.col("__for").isNull(), F.array(own)).otherwise(F.array(own, one(F.col("__for"), 1)))).alias("p"))
    placed = placed.select("p.part", "p.copy", "doc_id", "text").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[tuple[int, int, int | None, bytes]]]:
            held: list[tuple[int, int, int | None, bytes]] = []
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    held += zip(*[c.to_pylist() for c in batch.slice(a, 512).columns], strict=True)
                    yield held
                    held = held[-1:]  # its next row is still to come
            return

        for group in rows():
            pairs = [(a, b) for a, b in zip(group[:-1], group[1:], strict=True) if not a[1] and a[0] == b[0]]
            if not pairs:
                continue
            edited = []
            for a, b in pairs:
                text, other = a[3].decode(), b[3].decode()
                edited.append((len(text), (text[: len(text) - len(text) // 2] + other[: len(text) // 2]).encode()))
            plain = sketches([g[3] for g in group], kept)
            changed = sketches([e for _, e in edited], kept)
            out: list[list] = [[] for _ in range(7)]
            at = [i for i in range(len(group) - 1) if not group[i][1] and group[i][0] == group[i + 1][0]]
            for i, (n, e), c in zip(at, edited, changed, strict=True):
                for column, value in zip(out, (group[i][2], n, hashlib.sha256(e).hexdigest(), to_text(plain[i]), to_text(c), likeness(plain[i], c, kept), likeness(plain[i], plain[i + 1], kept)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
