"""Distributed order: parts ascending in the id, however rows and ids are spread."""

import collections
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from dishscope.llm import fingerprints, packed_ids
from dishscope.llm.common import range_partition, tie_of
from dishscope.llm.queries import tokenizer_file


def hot_rows(n=900):
    """A third without an id, a third of one id, a third with ids far apart; many equal rows."""
    rng = random.Random(5)
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else rng.choice([rng.randint(-50, 50), rng.randint(-(2**62), 2**62)]) for i in range(n)]
    return [(d, "same text" if k % 2 else f"text number {rng.randint(0, 40)} of some words") for k, d in enumerate(ids)]


def test_parts_ascend_and_split_hot_ids(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    placed, parts = range_partition(df, "doc_id", 50, tie_of(F.col("text")))
    got = [(r["__part"], r.doc_id, r.text) for r in placed.collect()]
    assert collections.Counter((d, t) for _, d, t in got) == collections.Counter(rows)
    assert all(0 <= p < parts for p, _, _ in got)
    key = lambda d: (d is not None, d or 0)
    ends = {}
    for p, d, _ in got:
        lo, hi = ends.get(p, (key(d), key(d)))
        ends[p] = (min(lo, key(d)), max(hi, key(d)))
    in_order = [ends[p] for p in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(in_order[:-1], in_order[1:], strict=True))
    assert max(collections.Counter(p for p, _, _ in got).values()) < 150


def test_files_and_fingerprints_of_hot_ids(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    path = tokenizer_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {x: [*t.encode(x, add_special_tokens=False).ids, 2] for _, x in rows}
    written = packed_ids.write(df, path, 2, f"{packed_ids.Scratch(spark, 'test').root}", docs_per_file=50).cache()
    got = sorted(packed_ids.read(written).collect(), key=lambda r: r.start)
    want = collections.Counter((d, len(ids[x]), zlib.crc32(np.array(ids[x], "<u4").tobytes())) for d, x in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    pairs = fingerprints.edited_pairs(df, 50).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in pairs) == collections.Counter((d, len(x)) for d, x in rows)


def test_long_words_and_texts():
    path = tokenizer_file("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        w = packed_ids.WordIds(f.read())
    w.STRETCH = 1000
    texts = ["x" * 30_000 + " tail", "É" * 9000, "12" * 4000 + ".", " ".join(["word's", "Ångström", "supercalifragilistic", "a1b2"] * 400), "", "  \n"]
    for x in texts:
        assert np.frombuffer(w.encode([x.encode()])[0], w.kind).tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids
    both = w.encode([x.encode() for x in texts])
    assert [len(b) for b in both] == [len(w.encode([x.encode()])[0]) for x in texts]
    w.table.MOST = 10  # forgotten units are learnt again
    assert w.encode([texts[3].encode()] * 3) == [both[3]] * 3
