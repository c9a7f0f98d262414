"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all
words; a source's target stops at three times its size and the excess goes to
the others by weight.  Each source's documents stand in a random order, are
taken in whole passes and one part of a pass, which leaves out rows too long for
what is missing until no row fits, and the taken stream is cut into blocks.  A tree
over the output shards splits the exact block quotas: at each node, how many blocks of each source go left is one multivariate-hypergeometric
draw, so the shards together are a uniform shuffle of all blocks, but no node
sees more than one number per source.  A shard then draws its own run of each
source's permuted blocks and shuffles its rows locally.

Everything is DataFrame expressions; random numbers are hashes of the seed and
what they stand for, so reruns agree.  Rows are taken one by one: repeated ids
or texts count as separate rows, ordered by their number in the scan where all else
is equal; of rows that would close a gap equally well the one of least key is taken.
Null text has size 0; a source without words has target 0, and rows without words are
taken once, spread over their source's blocks by a hash.  The sources themselves are one
small table (a row, and an array element in each tree node, per source).  The input is
read again for its rows and must be a scan, a written table or cached rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_names, numbered, pick, running_before, small, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources up to which their table is broadcast; with more, Spark picks the join.
FEW_SOURCES = 10_000
#: Partitions of a written mix; with more shards, neighbours share one.
MOST_PARTS = 100_000


SEED = 17


def _key(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    """The random number that orders a row within its source."""
    return F.xxhash64(F.lit(seed), doc_id, source, text)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good items among ``draws`` from ``total``, by inversion of ``u`` in [0, 1).

    Outcomes are gone through from the mode up, then from it down, as far as
    twelve standard deviations, where what is left is below double precision.
    """

    def body(s: Column) -> Column:
        n, k, d = s["n"], s["k"], s["d"]
        step = lambda x, to: F.when(  # noqa: E731  probability ratio of x+to to x
            F.lit(to > 0), (k - x) * (d - x) / ((x + 1.0) * (n - k - d + x + 1.0))
        ).otherwise(x * (n - k - d + x) / ((k - x + 1.0) * (d - x + 1.0)))

        def ranged(m: Column) -> Column:
            up = lambda body, zero: F.aggregate(F.sequence(F.lit(0), (m["hi"] - m["mode"]).cast("int")), zero, body)
            down = lambda body, zero: F.aggregate(F.sequence(F.lit(0), (m["mode"] - m["lo"]).cast("int")), zero, body)
            zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
            mass = lambda way: lambda a, i: F.struct((a["p"] * step(m["mode"] + way * i, way)).alias("p"), (a["sum"] + a["p"]).alias("sum"))
            z = F.struct(up(mass(1), zero)["sum"].alias("above"), down(mass(-1), zero)["sum"].alias("below"))

            def chosen(z: Column) -> Column:
                t = u * (z["above"] + z["below"] - 1.0)
                start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("x"))

                def seek(way: int, skip: Column):
                    def go(a: Column, i: Column) -> Column:
                        x = m["mode"] + way * i
                        here = F.when(skip & (i == 0), F.lit(0.0)).otherwise(a["p"])
                        return F.struct((a["p"] * step(x, way)).alias("p"), (a["sum"] + here).alias("sum"), F.when((a["x"] < 0) & (a["sum"] + here > (t if way > 0 else t - z["above"])), x).otherwise(a["x"]).alias("x"))

                    return go

                above = up(seek(1, F.lit(False)), start)["x"]
                below = down(seek(-1, F.lit(True)), start)["x"]
                return F.when(above >= 0, above).when(below >= 0, below).otherwise(m["mode"])

            return _let(z, chosen)

        sd = F.sqrt(d * k / n * (F.lit(1.0) - k / n) * (n - d) / F.greatest(n - 1.0, F.lit(1.0)))
        wide = F.ceil(12.0 * sd).cast("double") + 12.0
        mode = F.floor((d + 1.0) * (k + 1.0) / (n + 2.0)).cast("double")
        least, most = F.greatest(F.lit(0.0), d + k - n), F.least(d, k)
        mode = F.least(F.greatest(mode, least), most)
        spec = F.struct(mode.alias("mode"), F.greatest(least, mode - wide).alias("lo"), F.least(most, mode + wide).alias("hi"))
        return F.when(least >= most, least).otherwise(_let(spec, ranged))

    args = F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"), draws.cast("double").alias("d"))
    return F.when((total <= 0) | (good <= 0) | (draws <= 0), F.lit(0)).otherwise(_let(args, body)).cast("long")


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, k) from one row (k array of block counts by source): k are the shard's counts by source."""
    whole = F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = quotas.select(whole.alias("all"), F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("n"), "k")
    edge = lambda j: F.floor(F.col("all") * (j / F.lit(float(shards)))).cast("long")  # noqa: E731  blocks before shard j
    size = shards
    while size > 1:
        half = F.ceil(F.col("n") / 2).cast("long")
        take = edge(F.col("lo") + half) - edge(F.col("lo"))
        zero = F.struct((edge(F.col("lo") + F.col("n")) - edge(F.col("lo"))).alias("left"), take.alias("draws"), F.expr("cast(array() as array<bigint>)").alias("x"))

        def draw(a: Column, item: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("lo"), F.col("n"), item["i"])
            return _let(
                F.struct(hypergeometric(a["left"], item["v"], a["draws"], u).alias("x")),
                lambda got: F.struct((a["left"] - item["v"]).alias("left"), (a["draws"] - got["x"]).alias("draws"), F.concat(a["x"], F.array(got["x"])).alias("x")),
            )

        items = F.transform("k", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        drawn = nodes.withColumn("x", F.when(F.col("n") > 1, F.aggregate(items, zero, draw)["x"]).otherwise(F.col("k")))
        left = F.struct("lo", F.when(F.col("n") > 1, half).otherwise(F.col("n")).alias("n"), F.col("x").alias("k"))
        right = F.struct((F.col("lo") + half).alias("lo"), (F.col("n") - half).alias("n"), F.zip_with("k", "x", lambda k, x: k - x).alias("k"))
        children = F.when(F.col("n") > 1, F.array(left, right)).otherwise(F.array(left))
        nodes = drawn.select("all", F.explode(children).alias("c")).select("all", "c.lo", "c.n", "c.k")
        size = -(-size // 2)
    return nodes.select(F.col("lo").alias("shard"), "k")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """source, rank (from 0), source_size, target; one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    per = per.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    # sources reach their limits in the order of limit over weight
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    every = Window.partitionBy()
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("words", F.sum("source_size").over(every))
    level = (F.col("words") - F.coalesce(F.sum("limit").over(so_far), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("full", F.col("limit") <= F.col("weight") * level)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0))
    shared = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    per = per.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * (F.col("words") - spent) / shared))
    return per.select("source", "rank", "source_size", "n_docs", "target")


def _with_sources(df: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    s = sources.withColumnRenamed("source", "__source")
    s = F.broadcast(s) if few else s
    return df.join(s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix(docs: DataFrame, seed: int = SEED, block_words: int = 4096, shard_words: int = 1 << 20, docs_per_bucket: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(rows, copies).

    rows: rid, doc_id, key, source, size, source_size, target, of every input row.
    copies: rid, copy, shard, place, a row for each time a row is taken; ``place``
    orders the rows of a shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    base = numbered(pick(docs, "doc_id", "source", "text"), "rid").select(
        "rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _key(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"), seed).alias("key")
    )
    base = scratch.table(base, "rows")
    # rows that are equal many times over stand at many places
    often = scratch.table(base.groupBy("key").count().filter(F.col("count") > docs_per_bucket).select("key", F.lit(True).alias("often")), "often")
    base = base.join(small(often, often.count()), "key", "left")
    base = base.withColumn("key", F.when(F.col("often"), F.xxhash64("key", "rid")).otherwise(F.col("key"))).drop("often")
    sources = scratch.table(source_targets(base), "sources")
    few = sources.count() <= FEW_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = _with_sources(base, sources.withColumn("passes", whole), few)
    rows = rows.withColumn("want", F.col("target") - F.col("passes") * F.col("source_size"))
    buckets = F.ceil(F.col("n_docs") / docs_per_bucket)
    rows = rows.withColumn("bucket", F.floor(F.shiftrightunsigned(F.col("key"), 11) / F.lit(float(1 << 53)) * buckets).cast("long"))
    order = [F.shiftrightunsigned("key", 1), F.col("key"), F.col("doc_id"), F.col("size"), F.col("rid")]
    rows = scratch.table(running_before(rows, ["rank"], "bucket", order, "size", "before"), "placed")

    # the part of a pass: the rows that fit along the order; then again along it without
    # the rows that are too long for what is missing, until none fits; then the nearest row
    fits = F.col("before") + F.col("size") <= F.col("want")
    part = rows.filter(fits & (F.col("want") > 0)).groupBy("rank").agg(F.max(F.col("before") + F.col("size")).alias("part"))
    gaps = sources.select("rank", "source_size", whole.alias("passes"), (F.col("target") - whole * F.col("source_size")).alias("want")).join(part, "rank", "left")
    gaps = scratch.table(gaps.withColumn("part", F.coalesce("part", F.lit(0)).cast("long")), "gaps")
    rest = rows.filter(~fits & (F.col("size") > 0)).select("rank", "bucket", "rid", "doc_id", "key", "size")
    first = F.col("passes") * F.col("source_size") + F.col("part")
    fills, step = [], 0
    while True:
        open_gap = gaps.select("rank", (F.col("want") - F.col("part")).alias("missing"), F.col("passes").cast("int").alias("copy"), first.alias("first"))
        near = rest.join(F.broadcast(open_gap) if few else open_gap, "rank").filter(F.col("size") <= F.col("missing"))
        near = scratch.table(running_before(near, ["rank"], "bucket", order, "size", "skipped"), f"near{step}")
        closes = F.col("skipped") + F.col("size") <= F.col("missing")
        fill = near.filter(closes).select("rank", "rid", "size", "copy", (F.col("first") + F.col("skipped")).alias("at"))
        got = fill.groupBy("rank").agg(F.sum("size").alias("got"))
        gaps = scratch.table(gaps.join(got, "rank", "left").select("rank", "source_size", "passes", "want", (F.col("part") + F.coalesce("got", F.lit(0))).alias("part"), F.col("got").isNotNull().alias("more")), f"gaps{step}")
        fills.append(fill)
        if gaps.filter("more").isEmpty():
            break
        rest, step = near.filter(~closes).select("rank", "bucket", "rid", "doc_id", "key", "size"), step + 1
    # tables between keep each plan small, and with them the driver's memory
    filled = scratch.table(reduce(DataFrame.unionByName, fills), "fills")
    open_gap = gaps.select("rank", (F.col("want") - F.col("part")).alias("missing"), F.col("passes").cast("int").alias("copy"), first.alias("first"))
    off = F.abs(F.col("size") - F.col("missing"))
    near = rows.filter(~fits & (F.col("size") > 0)).select("rank", "rid", "size", "key").join(F.broadcast(open_gap) if few else open_gap, "rank").filter(off < F.col("missing"))
    near = near.join(filled.select("rid"), "rid", "left_anti").groupBy("rank", "copy", "first").agg(F.min_by(F.struct("rid", "size"), F.struct(off, F.col("key"), F.col("rid"))).alias("best"))
    last = scratch.table(near.select("rank", "best.rid", "best.size", "copy", F.col("first").alias("at")), "last")
    filled = filled.unionByName(last)
    gaps = gaps.join(last.select("rank", F.col("size").alias("got")), "rank", "left").withColumn("part", F.col("part") + F.coalesce("got", F.lit(0)))
    ends = gaps.select("rank", (F.col("passes") * F.col("source_size") + F.col("part")).alias("taken"))
    # a source of many rows without words has blocks for them
    ends = ends.join(sources.select("rank", "n_docs"), "rank")
    blocks = F.greatest(F.ceil(F.col("taken") / block_words), F.ceil(F.col("n_docs") / docs_per_bucket), F.lit(1))
    ends = scratch.table(ends.select("rank", "taken", blocks.cast("long").alias("blocks")), "ends")
    rows = rows.join(F.broadcast(ends) if few else ends, "rank")
    at = lambda p: F.col("before") + p * F.col("source_size")
    passes = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), at)).otherwise(F.expr("cast(array() as array<bigint>)"))
    none = F.expr("cast(array() as array<bigint>)")
    extra = F.when(fits & (F.col("want") > 0), F.array(at(F.col("passes")))).otherwise(none)
    once = F.when(F.col("size") > 0, F.concat(passes, extra)).otherwise(F.array(F.lit(0).cast("long")))
    taken = rows.select("rid", "rank", "size", "taken", "blocks", F.posexplode(once).alias("copy", "at"))
    filled = filled.join(F.broadcast(ends) if few else ends, "rank")
    taken = taken.unionByName(filled.select("rid", "rank", "size", "taken", "blocks", "copy", "at"))
    by_place = F.least(F.floor(F.col("at") * F.col("blocks") / F.greatest(F.col("taken"), F.lit(1))), F.col("blocks") - 1)
    taken = scratch.table(taken.withColumn("block", F.when(F.col("size") > 0, by_place).otherwise(F.pmod(F.xxhash64(F.lit(seed), "rid"), F.col("blocks"))).cast("long")).select("rid", "rank", "copy", "block"), "taken")

    # quotas down the tree, then each shard's run of every source's permuted blocks
    total = ends.agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    quotas = ends.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("blocks").alias("n")))).alias("all")).select(F.transform("all", lambda s: s["n"]).alias("k"), F.transform("all", lambda s: s["rank"]).alias("ranks"))
    tree = scratch.table(split_tree(quotas.select("k"), shards, seed), "tree")
    runs = tree.select("shard", F.posexplode("k").alias("rank", "n"))
    by_shard = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("first", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).filter("n > 0")
    draws = runs.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("nth"))
    blocks = ends.select("rank", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = blocks.withColumn("key", F.xxhash64(F.lit(seed + 1), "rank", "block")).withColumn("one", F.lit(1).cast("long"))
    blocks = blocks.withColumn("bucket", F.floor(F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53)) * F.ceil(F.col("blocks") / docs_per_bucket)).cast("long"))
    blocks = running_before(blocks, ["rank"], "bucket", [F.shiftrightunsigned("key", 1), F.col("key"), F.col("block")], "one", "nth").select("rank", "block", "nth")
    dealt = scratch.table(blocks.join(draws, ["rank", "nth"]).select("rank", "block", "shard"), "dealt")
    copies = taken.join(dealt, ["rank", "block"]).select("rid", "copy", "shard", F.xxhash64(F.lit(seed + 2), "shard", "rid", "copy").alias("place"))
    rows = scratch.table(rows.select("rid", "doc_id", "size", "source_size", "target"), "sized")
    copies = scratch.table(copies, "copies")
    scratch.clear(keep=["sized", "copies"])
    return rows, copies


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards its copies go to, of every row."""
    rows, copies = mix(docs, **options)
    times = copies.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("shard")).alias("shards"))
    out = rows.join(times, "rid", "left")
    taken = (F.col("size") * F.coalesce("n", F.lit(0))).cast("long")
    shards = F.coalesce("shards", F.expr("cast(array() as array<bigint>)"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), shards.alias("shards"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns they came with.

    A partition holds whole shards, each in its shuffled order.
    """
    _, copies = mix(docs, **options)
    rid, shard, place = free_names(docs, "_rid", "_shard", "_place")
    copies = copies.select(F.col("rid").alias(rid), F.col("shard").alias(shard), F.col("place").alias(place))
    last = copies.agg(F.max(shard)).first()[0]
    parts = min((last or 0) + 1, MOST_PARTS)
    rows = numbered(docs, rid).join(copies, rid)
    rows = rows.repartitionById(parts, (F.col(shard) * parts / F.lit((last or 0) + 1)).cast("int")).sortWithinPartitions(shard, place)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
