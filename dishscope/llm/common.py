"""Shared pieces: scratch tables in the folder all executors share, and distributed ordering."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import shared_folder

#: ASCII white space; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one operator call, written to the shared folder so that they outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        if _WATCHED:
            _WATCHED[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: a cut in the lineage."""
        self.names.append(name)
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(conf).delete(path, True)

    def clear(self, keep: list[str]) -> None:
        """Delete all tables but those that a returned result reads."""
        self.drop(*[n for n in dict.fromkeys(self.names) if n not in keep])


#: Lists of the scratch folders made inside ``temporary``, innermost last.
_WATCHED: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes the tables of all operators called inside, once their results have been written elsewhere."""
    _WATCHED.append([])
    try:
        yield
    finally:
        for scratch in _WATCHED.pop():
            scratch.drop("")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each made longer until no column has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with numbers by their place in the scan: the same in every scan of the same files or cached rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Rows of two or three numbers that may be broadcast; beyond that Spark picks the join.
FEW_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table for joining, broadcast where its counted rows allow."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder -1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(-1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Ranges told apart by quantiles; finer parts are cut within a range by its own ends.
COARSE = 1024


def range_partition(df: DataFrame, key: str, rows_each: int, tie: Column) -> tuple[DataFrame, int]:
    """(the rows with ``__part``, number of parts): about ``rows_each`` rows a part, ascending in the long ``key``, nulls first.

    Quantiles of the key column alone give at most ``COARSE`` ranges, and one grouped
    count their ends; a range is cut into as many equal widths as its rows ask
    for.  An id that holds many rows, and the rows without one, are ranges of their own,
    cut by the hash ``tie``.  So neither the plan nor what comes to the driver grows
    with the input, and errors of the quantiles change only how even the parts are.
    """
    n = df.count()
    if n <= rows_each:
        return df.withColumn("__part", F.lit(0)), 1
    k = min(-(-n // rows_each), COARSE)
    found = [int(c) for c in df.select(key).approxQuantile(key, [i / k for i in range(1, k)], 0.25 / k)]
    often = {a for a, b in zip(found[:-1], found[1:], strict=True) if a == b}
    cuts = sorted({*found, *(c + 1 for c in often if c < (1 << 63) - 1)})
    value = F.col(key).cast("long")
    ranges = F.when(value.isNull(), 0).otherwise(1 + _bisect(value, cuts))
    ends = df.select(ranges.alias("r"), value.alias("v")).groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    known = {r["r"]: r for r in ends}  # at most two ranges a quantile
    base, spec = 0, []
    for i in range(len(cuts) + 2):
        r = known.get(i)
        pieces = max(1, -(-r["n"] // rows_each)) if r else 1
        one_id = r is None or r["lo"] is None or r["lo"] == r["hi"]
        spec.append((base, pieces, 0 if one_id else r["lo"], 0.0 if one_id else float(r["hi"]) - float(r["lo"]) + 1))
        base += pieces if r else 0
    at = lambda j, kind: F.get(F.lit([s[j] for s in spec]).cast(f"array<{kind}>"), F.col("__range"))
    share = (value.cast("double") - at(2, "double")) / at(3, "double")
    by_tie = F.shiftrightunsigned(tie, 11) / F.lit(float(1 << 53))
    share = F.when(at(3, "double") > 0, share).otherwise(F.when(at(1, "int") > 1, by_tie).otherwise(0.0))
    piece = F.greatest(F.lit(0), F.least(at(1, "int") - 1, F.floor(share * at(1, "int")).cast("int")))
    return df.withColumn("__range", ranges.cast("int")).withColumn("__part", (at(0, "int") + piece).cast("int")).drop("__range"), max(base, 1)


def _bisect(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key."""
    n, steps = len(bounds), max(1, len(bounds).bit_length())
    array = F.lit(bounds).cast("array<long>")
    power = F.lit([1 << i for i in range(steps)]).cast("array<int>")

    def half(at: Column, bit: Column) -> Column:
        further = at + F.get(power, bit)
        return F.when((further <= n) & (F.get(array, further - 1) <= key), further).otherwise(at)

    return F.aggregate(F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), F.lit(0), half)


def tie_of(text: Column) -> Column:
    """A hash that tells rows of one id apart: by text, and equal texts by where they stand in the scan."""
    return F.xxhash64(text, F.pmod(F.monotonically_increasing_id(), F.lit(4096)))


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over the rows before each row of its group, in the order (bucket, order).

    Three levels keep every window small: rows within a bucket, buckets within a
    block of 1,024 buckets, blocks within the group.  ``bucket`` is a long.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("__sum")).withColumn("__block", F.floor(F.col(bucket) / 1024))
    in_block = Window.partitionBy(*group, "__block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy(*group, "__block").agg(F.sum("__sum").alias("__block_sum"))
    over = Window.partitionBy(*group).orderBy("__block") if group else Window.orderBy("__block")
    blocks = blocks.withColumn("__before_block", F.coalesce(F.sum("__block_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sums.withColumn("__in_block", F.coalesce(F.sum("__sum").over(in_block), F.lit(0))).join(blocks, [*group, "__block"]).select(*group, bucket, (F.col("__in_block") + F.col("__before_block")).alias("__start"))
    return (
        df.withColumn("__inner", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(starts, [*group, bucket])
        .withColumn(out, (F.col("__start") + F.col("__inner")).cast("long"))
        .drop("__inner", "__start")
    )
