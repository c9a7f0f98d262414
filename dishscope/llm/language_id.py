"""Language identification of web pages by fusing evidence in log odds.

Four kinds of evidence are added: the text's likelihood under a character model of
each language, the language the markup declares, the address's suffix, and a prior of
the host.  The character models count trigrams of code points of all labelled
documents.  What the others are worth comes from grouped counts of a first decision by
text alone, in which a page itself never counts: the host's share of a language is
smoothed towards its site's (the host's last three labels), that towards all pages',
each with the weight of ``PRIOR`` pages; a declaration counts by what other pages that
make it turn out to be, and a suffix by what the pages of other sites with it turn out
to be, both relative to all pages.

Neighbouring trigrams repeat each other, so a text of n trigrams weighs as
``WEIGHT`` * sqrt(n) independent ones (n, if fewer).  A page without text is decided by the other
evidence; a null url has no host and a null html no text.  Of equal sums the first
language by name is taken.  Without labelled documents language and probability are
null.  Every label is a language, however many there are: they are scored in blocks of
``AT_ONCE``, of which a worker holds one and the driver collects one, and a page's blocks
are put together in the end, so dirty labels fill neither.  Time, and the disk for the
log likelihoods, grow with pages times languages.  Every row gets its own result; equal
ones, equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, Scratch, pick

BITS = 18
PRIOR, WEIGHT = 5.0, 4.0
#: Languages of a block.
AT_ONCE = 64
#: Trigrams and scores of the pages that go through the blocks together in a worker.
WAITING = 1 << 22
#: Pages of a host (or site, suffix, declaration) beyond which its counts are broadcast, however many hosts there are.
HOT = 100_000


def visible(html: bytes) -> bytes:
    """The text of a page: without scripts, styles, comments and tags; in time linear in the page."""
    low, out, at, missing = html.lower(), [], 0, set()

    def close(mark: bytes, start: int) -> int:
        """Where the mark ends after ``start``, -1 without one; looked for to the end once only."""
        if mark in missing:
            return -1
        found = low.find(mark, start)
        if found < 0:
            missing.add(mark)
            return -1
        return found + len(mark)

    while True:
        tag = low.find(b"<", at)
        if tag < 0:
            break
        out.append(html[at:tag])
        end = close(b"-->", tag + 4) if low.startswith(b"<!--", tag) else -1
        if end < 0:
            end = close(b">", tag)
            if end < 0:  # a sign that opens nothing
                out.append(html[tag:])
                return b" ".join(out)
            for name in (b"script", b"style"):
                if low.startswith(name, tag + 1) and not low[tag + 1 + len(name) : tag + 2 + len(name)].isalnum():
                    last = close(b"</" + name, end)
                    last = close(b">", last) if last >= 0 else -1
                    end = max(end, last)
        at = end
    out.append(html[at:])
    return b" ".join(out)


def _grams(text: bytes) -> np.ndarray:
    plain = (b" " + b" ".join(text.lower().split()) + b" ").decode("utf-8", "replace")
    data = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32)
    mixed = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA6B) ^ data[2:] * np.uint32(0xC2B2AE35)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)


def train(documents: DataFrame, scratch: Scratch, label: str = "lang") -> tuple[list[str], list[Broadcast]]:
    """Languages, and their counts of hashed trigrams in all labelled documents, a block of at most ``AT_ONCE`` languages a broadcast.

    A block holds its first language, the log probability of a trigram that a language
    never has, and for the trigrams that one has: trigram, language (its place in the
    block), and by how much its log probability is above that.
    """
    sc = documents.sparkSession.sparkContext
    rows = pick(documents, "text", label).filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("text").cast("binary").alias("text"), F.col(label).cast("string").alias("lang"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return [], []
    width = min(len(langs), AT_ONCE)
    places = sc.broadcast({g: i for i, g in enumerate(langs)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, place = [], [], 0, places.value

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            return key[at], np.add.reduceat(n, at)

        def out(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(key), 1 << 16):
                k = key[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((k >> BITS).astype(np.int32)), pa.array((k & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n[a : a + (1 << 16)])], ["lang", "gram", "n"])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for t, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    g, n = np.unique(_grams(t), return_counts=True)
                    keys.append(g.astype(np.int64) | (place[lang] << BITS))
                    counts.append(n.astype(np.int64))
                    held += len(g) + 1
                    if held >= WAITING // 2:
                        key, n = merged()
                        if 2 * len(key) > held:  # too many to keep: on to the sums
                            yield from out(key, n)
                            key, n = key[:0], n[:0]
                        keys, counts, held = [key], [n], len(key)
        if held:
            yield from out(*merged())

    counted = rows.mapInArrow(run, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    if len(langs) > width:
        counted = scratch.table(counted.orderBy("lang"), "counts")
    blocks = []
    for first in range(0, len(langs), width):
        part = counted.filter(F.col("lang").between(first, first + width - 1)) if len(langs) > width else counted
        found = part.toArrow()  # at most 2^18 rows a language
        lang, gram, n = (found.column(c).to_numpy() for c in ("lang", "gram", "n"))
        size = np.bincount(lang - first, weights=n, minlength=min(width, len(langs) - first))
        blocks.append(sc.broadcast((first, np.log(0.5 / (size + 0.5 * (1 << BITS))), gram, (lang - first).astype(np.int16), np.log1p(2.0 * n).astype(np.float32))))
    scratch.drop("counts")
    return langs, blocks


def _held_once(shared: Broadcast) -> tuple:
    """The value of a broadcast; the worker does not keep it, so that it holds one block at a time."""
    value = shared.value
    if getattr(shared, "_path", None):
        shared.__dict__.pop("_value", None)
    return value


def likelihoods(waiting: list[tuple[np.ndarray, np.ndarray]], blocks: list[Broadcast], n: int, above: np.ndarray) -> np.ndarray:
    """Log likelihoods of texts (their trigrams, and how often) by language, less their largest; ``above`` is all zeros, before and after."""
    out = np.zeros((len(waiting), n))
    for block in blocks:
        first, never, gram, lang, more = _held_once(block)
        above[gram, lang] = more
        for i, (g, often) in enumerate(waiting):
            if len(g):
                s, size = np.zeros(above.shape[1]), often.sum()
                for a in range(0, len(g), 1 << 13):  # row by row, so that equal languages get equal sums
                    s += (above[g[a : a + (1 << 13)]] * often[a : a + (1 << 13), None]).sum(axis=0)
                out[i, first : first + len(never)] = (s[: len(never)] + size * never) * min(1.0, WEIGHT / np.sqrt(size))
        above[gram, lang] = 0
    out -= out.max(axis=1, keepdims=True)
    return out


def evidence(pages: DataFrame, blocks: list[Broadcast], n: int) -> DataFrame:
    """row, page_id, declared, host, site, suffix, own (the first decision), and a row a block of languages: block, text.

    ``text`` has the block's log likelihoods, less the largest of all blocks.
    """
    width = min(n, AT_ONCE)
    names = ["row", "page_id", "declared", "host", "site", "suffix", "own", "block", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = np.zeros((1 << BITS, width), np.float32)

        def decided(rows: pa.RecordBatch, waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            logs = likelihoods(waiting, blocks, n, above)
            sure = (logs.min(axis=1) < 0) | (n == 1)
            own = pa.array(logs.argmax(axis=1).astype(np.int32), mask=~sure)
            for b, first in enumerate(range(0, n, width)):
                part = np.ascontiguousarray(logs[:, first : first + width])
                ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                text = pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], own, pa.array(np.full(len(part), b, np.int32)), text], names)

        for batch in batches:
            start, waiting, held = 0, [], 0
            for a in range(0, batch.num_rows, 64):  # few pages at once
                for t in batch.column(batch.num_columns - 1).slice(a, 64).to_pylist():
                    g, often = np.unique(_grams(visible(t or b"")), return_counts=True)
                    waiting.append((g, often.astype(np.float64)))
                    held += 2 * len(g) + n
                    if held >= WAITING:
                        yield from decided(batch.slice(start, len(waiting)), waiting)
                        start, waiting, held = start + len(waiting), [], 0
            if waiting:
                yield from decided(batch.slice(start, len(waiting)), waiting)

    rows = pick(pages, "page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?i)^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), declared.alias("declared"), host.alias("host"), F.substring_index(host, ".", -3).alias("site"), F.substring_index(host, ".", -1).alias("suffix"), F.col("html").cast("binary").alias("body"))
    return rows.mapInArrow(run, "row long, page_id long, declared string, host string, site string, suffix string, own int, block int, text array<double>")


def with_counts(rows: DataFrame, own: DataFrame, key: str, name: str, n: int, scratch: Scratch) -> DataFrame:
    """The rows with ``name``: first decisions for the block's languages among the pages with the same ``key``, and ``name``_all: for any.

    Few counts are broadcast; of many, those of keys with very many pages are, and the others joined.
    """
    width, pages = min(n, AT_ONCE), f"{name}_all"
    each = [F.sum(F.when(F.col("own") % width == k, 1.0).otherwise(0.0)) for k in range(width)]
    table = own.groupBy(key, F.floor(F.col("own") / width).cast("int").alias("part")).agg(F.array(*each).alias("counts"), F.count(F.lit(1)).alias("pages"))
    # blocks without a first decision for the key are left out
    table = table.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("part", "counts"))).alias(name), F.sum("pages").alias(pages))
    table = scratch.table(table, name)
    numbers = (table.agg(F.sum(F.size(name))).first()[0] or 0) * width
    if numbers <= 3 * FEW_ROWS:
        met = rows.join(F.broadcast(table), key, "left")
    else:
        met = rows.join(F.broadcast(table.filter(F.col(pages) > HOT)), key, "left")  # few, since each has many pages
        rest = met.filter(F.col(name).isNull()).drop(name, pages).join(table.filter(F.col(pages) <= HOT), key, "left")
        met = met.filter(F.col(name).isNotNull()).unionByName(rest)
    counts = F.coalesce(F.slice(F.try_element_at(name, F.col("block")), F.lit(1), F.size("text")), F.transform("text", lambda x: F.lit(0.0)))
    return met.withColumn(name, counts).withColumn(pages, F.coalesce(F.col(pages).cast("double"), F.lit(0.0)))


def _both(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host of every page."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "language")
    langs, blocks = train(documents, scratch)
    if not langs:
        none = F.lit(None).cast("string")
        return pick(pages, "page_id").select(F.col("page_id").cast("long").alias("page_id"), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    n = len(langs)
    width = min(n, AT_ONCE)
    rows = scratch.table(evidence(pages, blocks, n), "evidence")
    own = rows.filter("own is not null and block = 0")
    whole = {r["own"]: r["count"] for r in own.groupBy("own").count().collect()}  # a row a language
    starts = range(0, n, width)
    each = pa.table({
        "block": pa.array(range(len(starts)), pa.int32()),
        "names": pa.array([langs[a : a + width] for a in starts], pa.list_(pa.string())),
        "everything": pa.array([[float(whole.get(k, 0)) for k in range(a, min(a + width, n))] for a in starts], pa.list_(pa.float64())),
    })
    rows = rows.join(F.broadcast(spark.createDataFrame(each)), "block")
    for key, name in (("host", "by_host"), ("site", "by_site"), ("suffix", "by_suffix"), ("declared", "by_declared")):
        rows = with_counts(rows, own.select(key, "own"), key, name, n, scratch)
    place = F.col("own") - F.col("block") * width  # of the first decision; outside the block in all others
    self_ = F.transform("text", lambda x, i: F.when(place == i, 1.0).otherwise(0.0))
    one = F.when(F.col("own").isNull(), 0.0).otherwise(1.0)
    # counts of the other pages; of the other sites' pages for the suffix
    less = lambda c, d: _both(c, d, lambda x, y: x - y)
    rows = rows.withColumn("c_all", less(F.col("everything"), self_)).withColumn("c_declared", less(F.col("by_declared"), self_))
    rows = rows.withColumn("c_suffix", less(F.col("by_suffix"), F.col("by_site"))).withColumn("c_site", less(F.col("by_site"), self_)).withColumn("c_host", less(F.col("by_host"), self_))
    # and their sums over all blocks
    rows = rows.withColumn("t_all", F.lit(float(sum(whole.values()))) - one).withColumn("t_declared", F.col("by_declared_all") - one)
    rows = rows.withColumn("t_suffix", F.col("by_suffix_all") - F.col("by_site_all")).withColumn("t_site", F.col("by_site_all") - one).withColumn("t_host", F.col("by_host_all") - one)

    def share(kind: str, up: Column) -> Column:
        """Smoothed shares of the counts of a kind, towards ``up`` with the weight of PRIOR pages."""
        return _both(F.col(f"c_{kind}"), up, lambda x, p: (x + PRIOR * p) / (F.col(f"t_{kind}") + PRIOR))

    rows = rows.withColumn("base", F.transform("c_all", lambda x: (x + 1.0) / (F.col("t_all") + float(n))))
    rows = rows.withColumn("prior", share("host", share("site", F.col("base"))))
    ones = F.transform("text", lambda x: F.lit(1.0))
    ratio = lambda kind: _both(share(kind, F.col("base")), F.col("base"), lambda s, b: s / b)
    rows = rows.withColumn("said", F.when(F.col("declared") == "", ones).otherwise(ratio("declared"))).withColumn("ending", F.when(F.col("suffix") == "", ones).otherwise(ratio("suffix")))
    add = lambda z, p: _both(z, p, lambda x, y: x + F.log(y))
    rows = rows.withColumn("z", add(add(add(F.col("text"), F.col("prior")), F.col("said")), F.col("ending")))
    top = F.array_max("z")
    part = F.struct("block", top.alias("top"), F.element_at("names", F.array_position("z", top).cast("int")).alias("lang"), F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - top)).alias("mass"))
    rows = rows.select("row", "page_id", "declared", "host", F.get("names", place).alias("text_lang"), part.alias("part"))
    if n > width:  # a page's blocks together, in order
        rows = rows.groupBy("row").agg(*[F.max(c).alias(c) for c in ("page_id", "declared", "host", "text_lang")], F.array_sort(F.collect_list("part")).alias("parts"))
    else:
        rows = rows.withColumn("parts", F.array("part"))
    best = F.array_max(F.transform("parts", lambda p: p["top"]))
    rows = rows.withColumn("best", best)
    first = F.get(F.filter("parts", lambda p: p["top"] == F.col("best")), F.lit(0))["lang"]
    chance = 1.0 / F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["mass"] * F.exp(p["top"] - F.col("best")))
    return rows.select("page_id", first.alias("lang"), chance.alias("probability"), "text_lang", "declared", "host")
