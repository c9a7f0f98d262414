"""Block bootstrap of means, with draws that follow from hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, n: Column, *parts: Column) -> Column:
    """A number 0..n-1 from the seed and what it is drawn for."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def drawn_hashes(seed: int, rep: int, first: int, last: int) -> np.ndarray:
    """What ``draw`` takes its numbers from, for the draws ``first`` to ``last`` - 1 of a resample."""
    start, md5 = f"{seed}|{rep}|".encode(), hashlib.md5
    return np.frombuffer(b"".join([md5(start + b"%d" % d).digest()[:4] for d in range(first, last)]), ">u4").astype(np.uint32)


class Hashes:
    """The hashes of draws, which all groups share: those of a task's first pieces are remembered."""

    PIECE, MOST = 1 << 15, 512  # 64 MB

    def __init__(self, seed: int):
        self.seed, self.known, self.size = seed, {}, 0

    def pieces(self, rep: int, n: int):
        """(first draw, hashes) of a resample of n draws, piece by piece."""
        for first in range(0, n, self.PIECE):
            need = min(self.PIECE, n - first)
            got = self.known.get((rep, first), np.zeros(0, np.uint32))
            if len(got) < need:
                more = drawn_hashes(self.seed, rep, first + len(got), first + need)
                got = np.concatenate([got, more])
                if self.size + len(more) <= self.PIECE * self.MOST:
                    self.size += len(more)
                    self.known[rep, first] = got
            yield first, got[:need]


#: Above so many blocks a group's resamples go to several tasks, which share them.
MANY, SHARES, PARTS = 1_000, 8, 64


def resampled(blocks: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """keys, _m: means of resamples, from a row a block (keys, _i from 0, _blocks, _s, _n).

    A task holds one group's block sums and makes some or all of its resamples there.
    """
    share = F.when(F.col("_blocks") > MANY, SHARES).otherwise(1)
    rows = blocks.withColumn("_shares", share).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    # resamples of the same numbers meet in a task, so that it makes their hashes once
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), (F.lit(PARTS) / F.col("_shares")).cast("long")))
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join([*[f"{k} {kind[k]}" for k in keys], "_m double"])
    hashes = Hashes(seed)

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        n, shares, share = len(pdf), int(pdf["_shares"].iloc[0]), int(pdf["_share"].iloc[0])
        s, counts, at = np.zeros(n), np.zeros(n, np.int64), pdf["_i"].to_numpy()
        s[at], counts[at] = pdf["_s"].to_numpy(float), pdf["_n"].to_numpy()
        out = []
        for rep in range(share, n_boot, shares):
            total, size = 0.0, 0
            for _, h in hashes.pieces(rep, n):
                i = h % np.uint32(n)
                total, size = total + float(s[i].sum()), size + int(counts[i].sum())
            out.append(total / size)
        got = pd.DataFrame({"_m": out}, dtype=float)
        for k in reversed(keys):
            got.insert(0, k, [pdf[k].iloc[0]] * len(out))
        return got

    slim = rows.select(*keys, "_i", "_s", "_n", "_shares", "_share", "_part").repartition(2 * PARTS, "_share", "_part")
    return slim.groupBy(*keys, "_share", "_part").applyInPandas(means, schema)


def block_bootstrap(df: DataFrame, keys: list[str], block: str, value: str, n_boot: int = 200, level: float = 0.95, seed: int = 1) -> DataFrame:
    """keys, lo, hi: quantiles of resampled means; null for fewer than 2 values, 3 blocks or 10 resamples.

    Blocks are summed first, so a resample draws as many block sums as there are
    blocks, by their numbers in ``draw``; only block sums are repeated, never rows.
    """
    blocks = df.filter(F.col(value).isNotNull()).groupBy(*keys, block).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*keys)
    blocks = blocks.withColumn("_i", F.row_number().over(every.orderBy(block)) - 1).withColumn("_blocks", F.count(F.lit(1)).over(every)).withColumn("_rows", F.sum("_n").over(every))
    usable = blocks.filter((F.col("_blocks") >= 3) & (F.col("_rows") >= 2)) if n_boot >= 10 else blocks.filter(F.lit(False))
    means = resampled(usable, keys, n_boot, seed)
    half = (1 - level) / 2
    return means.groupBy(*keys).agg(F.percentile("_m", F.lit(half)).alias("lo"), F.percentile("_m", F.lit(1 - half)).alias("hi"))
