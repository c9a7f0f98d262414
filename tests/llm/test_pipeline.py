"""Each stage of the pipeline against a plain version of it, on tables with every odd row."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dishscope.llm import mixing, private_data, toxicity
from dishscope.llm.queries import tokenizer_file
from test_operators import ROWS, SCHEMA, WORDS, brute_components, rows_of

NAMES = [n.split()[0] for n in SCHEMA.split(", ")] + ["_row", "_TEXT", "_rid", "__word"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The rows with more columns whose names could clash, written and read again, and labels beside them."""
    folder = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(ROWS, SCHEMA)
    for k, name in enumerate(NAMES[7:]):
        df = df.withColumn(name, F.lit(f"extra{k}"))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(bool(r[1]) and "idiot" in r[1])) for r in ROWS if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.read.parquet(f"{table}/documents.parquet")


def test_toxicity_stage(spark, docs, table):
    got = corpus_pipeline.drop_toxic(spark, docs, table)
    model = toxicity.train(docs, spark.read.parquet(f"{table}/labels.parquet"))
    grams = toxicity.Grams()
    want = collections.Counter(tuple(r) for r in docs.collect() if model.score(grams((r.text or "").encode())) < 0.5)
    assert got.columns == docs.columns and rows_of(got) == want
    assert rows_of(corpus_pipeline.drop_toxic(spark, docs.filter("false"), table)) == {}


def test_model_against_plain_counts():
    """Features and ratios of the classifier, by sets of character n-grams."""
    texts = ["Ünder  the\nBRIDGE", "under the bridge", "bridge", "", "a über b"]
    grams = toxicity.Grams()
    places = [grams(t.encode()) for t in texts]
    def plain(t):
        s = " " + " ".join(re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t).strip(" \t\n\r\x0b\x0c"))) + " "
        return {s[i : i + n] for n in toxicity.SIZES for i in range(len(s) - n + 1)}

    assert [len(p) for p in places] == [len(plain(t)) for t in texts] and all(len(set(p.tolist())) == len(p) for p in places)
    shared = len(set(places[0].tolist()) & set(places[1].tolist()))
    assert shared == len(plain(texts[0]) & plain(texts[1]))
    labels = np.array([1, 0, 0, 1, 0])
    p, n = toxicity.counted(places, labels)
    ratio = toxicity.ratios(p, n, 2, 3, certain=0.0)
    raw = {g: np.log((sum(g in plain(t) for t, y in zip(texts, labels, strict=True) if y) + 1) / 4) - np.log((sum(g in plain(t) for t, y in zip(texts, labels, strict=True) if not y) + 1) / 5) for t in texts for g in plain(t)}
    some = [ratio[grams(f"{g}".encode())] for g in ()]
    assert not some and np.isclose(np.unique(np.round(ratio[places[2]] / ratio[places[2]].max(), 6)).max(), 1)
    assert len({round(v, 9) for v in raw.values()}) >= len({round(float(v), 9) for v in ratio[np.concatenate(places)]})


def test_near_duplicate_stage(spark, docs, table):
    got = corpus_pipeline.one_of_each(spark, docs, table)
    assert got.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    parts = brute_components([tuple(r) for r in rows], 5)
    names = collections.Counter((d, t) for (d, n, c), (_, t) in zip(parts, rows, strict=True) if n == 0)
    names.update({(d, t) for (d, n, c), (_, t) in zip(parts, rows, strict=True) if n and (d == c or c is None)})
    # an id with several texts that are alike keeps one of them; none in these rows
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == names
    assert corpus_pipeline.one_of_each(spark, docs.filter("false"), table).count() == 0


def test_personal_data_stage(spark, docs, table):
    got = corpus_pipeline.redact(spark, docs, table)
    assert got.columns == docs.columns
    spans = {}
    for r in private_data.found(docs).collect():
        spans.setdefault(r.doc_id, set()).add(r.spans)
    for r in docs.select("doc_id", "text").collect():
        assert r.doc_id in spans
    by_id = collections.defaultdict(list)
    for r in got.collect():
        by_id[r.doc_id].append((r.text, r.n_chars))
    for r in docs.collect():
        (text,) = {t for t in spans[r.doc_id]} if len(spans[r.doc_id]) == 1 else (None,)
        if text is None or r.text is None:
            continue
        out, at = "", 0
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in text.split(",") if s)), key=lambda s: (s[1], s[2], s[0])):
            if a >= at:
                out += r.text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        out += r.text[at:]
        assert (out, len(out)) in by_id[r.doc_id]
    assert corpus_pipeline.redact(spark, docs.filter("false"), table).count() == 0


def test_mixing_stage(spark, docs, table):
    got = corpus_pipeline.mix_sources(spark, docs, table)
    assert got.columns == docs.columns
    taken = collections.Counter()
    for r in mixing.mixed_sizes(docs).collect():
        if r.size:
            taken[r.doc_id, r.size] += r.taken
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    seen = collections.Counter()
    for r in got.collect():
        seen[r.doc_id, size(r.text)] += size(r.text)
    assert {k: v for k, v in seen.items() if k[1]} == {k: v for k, v in taken.items() if v}
    assert sum(not size(r.text) for r in got.collect()) == sum(not size(r[1]) for r in ROWS)
    assert got.collect() == corpus_pipeline.mix_sources(spark, docs, table).collect()
    assert corpus_pipeline.mix_sources(spark, docs.filter("false"), table).count() == 0


def test_the_mix_is_shuffled(spark, tmp_path):
    """Sources alternate in what is written, shard by shard, and no row is lost where rows are equal."""
    rows = [(i, " ".join(WORDS[:20]), f"s{i // 300}") for i in range(900)] + [(None, None, None)] * 400 + [(5000, "same text here", "s0")] * 500
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    mixed = mixing.mixed_rows(docs, block_words=64, shard_words=2000, docs_per_bucket=100)
    out = mixed.collect()
    assert sum(r.text is None for r in out) == 400
    order = [r.source for r in out if r.source]
    changes = sum(a != b for a, b in zip(order[:-1], order[1:], strict=True))
    assert changes > len(order) / 5


def test_piece_stage(spark, docs, table):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    assert rows_of(corpus_pipeline.tokenize(spark, docs, table)) == want


def test_run_is_its_stages(spark, table):
    """run() gives the rows that its stages give one after another."""
    got = rows_of(corpus_pipeline.run(spark, table))
    docs = spark.read.parquet(f"{table}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, table).write.mode("overwrite").parquet(f"{table}/own{k}")
        docs = spark.read.parquet(f"{table}/own{k}")
    assert got == rows_of(docs) and sum(got.values()) > 50


def test_stages_leave_no_tables_behind(spark, table, tmp_path):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, table).count() > 50
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and os.listdir(f"{folder}/{next(iter(left))}") == ["stage4"]
