"""What the trees of op8 select, against planted truth that no tree has seen."""

import random

import pytest
from pyspark.sql import functions as F

from dishscope.llm import private_data as P
from dishscope.llm.common import remainder


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = "the harbour was quiet when she wrote that letter about rain and bread for seven people in town".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(1500)]
    return spark.createDataFrame([*rows, (None, "no id"), (9001, None), (9002, "")], "doc_id long, text string").cache()


def test_selected_spans_on_stretches_no_tree_has_seen(docs):
    model = P.train(docs)
    held = P.planted(docs).filter(remainder("doc_id", 5) == 0).cache()
    base = P.base_spans(F.col("text"))
    bare = {k: F.transform(F.col(k), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))) for k in P.KINDS}
    rows = held.withColumns({k: base[k] for k in P.KINDS}).withColumn("found", P.candidates(F.col("text")))
    every = P.all_spans(bare, F.col("found"), model)
    same = lambda s: (s["start"] == F.col("start")) & (s["end"] == F.col("end"))
    got = {}
    for k in P.KINDS:
        own = rows.filter(F.col("kind") == k).withColumn("every", every[k]).withColumn("base", bare[k])
        r = own.agg(
            F.sum((F.col("real") & F.exists("every", same)).cast("int")).alias("all_right"),
            F.sum((F.col("real") & F.exists("base", same)).cast("int")).alias("base_right"),
            F.sum((~F.col("real") & F.exists("every", same) & ~F.exists("base", same)).cast("int")).alias("added_wrong"),
            F.sum(F.col("real").cast("int")).alias("real"),
        ).first()
        got[k] = r
        added = r.all_right - r.base_right
        assert r.all_right >= r.base_right and r.added_wrong <= max(3, 0.06 * max(added, 1)), (k, r)
    # much of what the base patterns leave out is found
    assert got["email"].all_right > 2 * got["email"].base_right and got["ip"].all_right > 1.4 * got["ip"].base_right
    assert got["card"].all_right > 1.05 * got["card"].base_right


def test_labels_do_not_follow_from_checks(docs):
    """Look-alikes pass the checks, and personal data may fail to: only what was planted says which is which."""
    rows = P.labelled(P.planted(docs).cache())
    seen = rows.groupBy(F.col("c.kind").alias("kind"), F.col("c.luhn").alias("luhn"), F.col("c.octets").alias("octets"), "real").count().collect()
    of = {(r.kind, r.luhn, r.octets, r.real): r["count"] for r in seen}
    assert of[2, 1, 0, False] > 0 and of[2, 1, 0, True] > 0 and of[1, 0, 1, False] > 0 and of[1, 0, 1, True] > 0


def test_context_around_matches(spark):
    text = "a1 x@y.zz,b@c.dd end"
    h = spark.range(1).select(P.hits(F.lit(text), P.BASE["email"], F.lit(True)).alias("h")).first().h
    assert [(s.start, s.end, s.value, s.before, s.after) for s in h] == [(3, 9, "x@y.zz", "a1 ", ","), (10, 16, "b@c.dd", "x@y.zz,", " ")]
    assert P.found(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).count() == 2


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.cc now", 1, 2, 3, "m"), (2, None, 4, 5, 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _email int, _spans int, _TEXT int, n_chars string")
    got = sorted(P.redacted(df).collect())
    assert [tuple(r)[:5] for r in got] == [(1, "mail [EMAIL] now", 1, 2, 3), (2, None, 4, 5, 6)] and got[0].n_chars == 16 and got[1].n_chars is None
