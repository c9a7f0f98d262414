"""Each operator against plain versions, on small tables with every odd row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishscope.llm import brown_lm, fingerprints, language_id, mixing, near_dedup, packed_ids, prefix_bpe, private_data, toxicity, vector_file
from dishscope.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score double"
WORDS = "the of and to in is that it was for on with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


def make(seed=3, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", str(rng.randint(0, 99))]) for _ in range(rng.randint(30, 120)))
        rows.append([i, text, "en", f"s{i % 5}"])
    for k in range(20):  # copies, near copies
        rows.append([1000 + k, rows[k][1], "en", "s0"])
        near = rows[k + 20][1].split()
        near[rng.randrange(len(near))] = "changed"
        rows.append([2000 + k, " ".join(near), "en", "s1"])
    rows += [[3000, None, None, None], [3001, "", "en", "s2"], [3002, "  \n ", "en", None], [None, "a row without an id that is long enough", "en", "s1"], [3003, "word " * 6000, "en", "s3"], [3004, "short one", "en", "s3"], [3004, "short one", "en", "s3"], [3005, "Ünïcode▁ tail 日本 👍 email me: x@y.zz now", "de", "s4"], [3006, "idiot scum " * 5, "en", "s4"]]
    return [(*r, len(r[1] or ""), "clash", 0.5) for r in rows]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_language_model(docs, empty):
    got = brown_lm.scored(docs).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = collections.Counter(t for r in ROWS if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for r in ROWS:
        t = tokens(r[1])
        want[r[0], held(r[0]), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert brown_lm.scored(empty).count() == 0


def plain_score(rows, m, vocabulary, scratch_counts, n, v):
    """The model's score of each text, token by token with Python numbers, from its tables."""
    number = {w: i for i, w in enumerate(vocabulary)}
    out = []
    for _, text in rows:
        before, total = m.classes.of_end, 0.0
        for t in [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")), None]:
            if t is None:
                c, c_of, emit = m.n_docs, m.classes.of_end, m.emit_end
            elif t in number:
                i = number[t]
                c, c_of, emit = int(m.counts[i]), int(m.classes.of_words[i]), float(m.emit[i])
            else:
                data, at, size, _, _ = words_of([t.encode()])
                g = int(brown_lm.shapes_of(data, at, size)[0])
                c, c_of = scratch_counts.get(t, 0), int(m.classes.of_groups[g])
                emit = float(m.emit_group[g]) * (c + 0.1)
            total += math.log10(0.9 * float(m.step[before, c_of]) * emit + 0.1 * (c + 0.1) / (n + 0.1 * (v + 1)))
            before = c_of
        out.append(total)
    return out


def words_of(texts):
    from dishscope.llm.words import joined, words

    return words(joined(texts)[0])


def test_language_model_score_token_by_token(spark, docs, monkeypatch):
    kept = {}
    plain = brown_lm.trained
    monkeypatch.setattr(brown_lm, "CORE", 30)  # so that words are inserted too

    def keep(rows, counts, shared, *a):
        kept["model"], kept["words"] = plain(rows, counts, shared, *a), {bytes(r["word"]).decode(): r["n"] for r in counts.collect()}
        kept["vocabulary"] = shared.value
        return kept["model"]

    monkeypatch.setattr(brown_lm, "trained", keep)
    monkeypatch.setattr(brown_lm, "_units", lambda ids, shapes: np.where(ids == brown_lm._END, brown_lm.END, np.where((ids >= 0) & (ids < 30), ids, brown_lm.CORE + 0 * ids + np.where(ids >= 0, shapes[np.where((ids >= 0) & (ids != brown_lm._END), ids, 0)], -1 - ids))).astype(np.int64))
    got = brown_lm.scored(docs).collect()
    m, counts = kept["model"], kept["words"]
    order = sorted((w for w in counts if counts[w] >= 5), key=lambda w: (-counts[w], w.encode()))
    assert [counts[w] for w in order] == m.counts.tolist()
    n, v = got[0].train_tokens, len(counts) + 1
    want = plain_score([(r[0], r[1]) for r in ROWS], m, order, counts, n, v)
    assert np.allclose(sorted(want), sorted(r.score for r in got), rtol=1e-9)
    # the vocabulary's words and the groups share out each class
    groups = m.emit_group * 0
    mass = np.array([sum(c for w, c in counts.items() if c < 5 and int(brown_lm.shapes_of(*words_of([w.encode()])[:3])[0]) == g) for g in range(brown_lm.SHAPES)])
    kinds = np.array([sum(1 for w, c in counts.items() if c < 5 and int(brown_lm.shapes_of(*words_of([w.encode()])[:3])[0]) == g) for g in range(brown_lm.SHAPES)])
    groups = m.emit_group * (mass + 0.1 * (kinds + 1))
    total = np.bincount(m.classes.of_words, m.emit, brown_lm.CLASSES) + np.bincount(m.classes.of_groups, groups, brown_lm.CLASSES)
    total[m.classes.of_end] += m.emit_end
    assert np.allclose(total[total > 0], 1) and np.allclose(m.step.sum(axis=1), 1)


def test_held_out_perplexity_is_below_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = brown_lm.scored(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-r.s / r.n) < 0.65 * 10 ** (-r.b / r.n)


def test_exchange_reaches_a_point_where_nothing_moves():
    rng = np.random.default_rng(1)

    def likelihood(pairs, of, k):
        m = np.zeros((k, k))
        for a in range(k):
            for b in range(k):
                m[a, b] = pairs[np.ix_(of == a, of == b)].sum()
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))

    pairs = rng.integers(0, 6, (25, 25)).astype(float) * (rng.random((25, 25)) < 0.3)
    of = brown_lm.exchange(pairs, 4)
    best = likelihood(pairs, of, 4)
    for w in range(25):
        for k in range(4):
            other = of.copy()
            other[w] = k
            assert likelihood(pairs, other, 4) <= best + 1e-6
    # a word beyond the core: the gain of each class is the difference of likelihoods
    w = int(np.argmax(pairs.sum(axis=0) + pairs.sum(axis=1)))
    pairs[w, w] = 0
    both = np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(4)] for a in range(4)])
    left, right = (np.array([[x[of == k].sum() for k in range(4)]]) for x in (pairs[:, w], pairs[w]))
    gain = brown_lm.insertion_gains(left, right, of[[w]], both)[0]
    true = np.array([likelihood(pairs, np.where(np.arange(25) == w, k, of), 4) for k in range(4)])
    assert int(np.argmax(gain)) == int(np.argmax(true)) and np.allclose(gain - gain[of[w]], true - true[of[w]], atol=1e-6)


def test_words_of_any_kind():
    texts = ["A\x00b a\x00b a", "x" * 40 + " " + "X" * 40, "", "ß É\u00a0f\x1cg", "\x00 \x00\x00"]
    data, at, size, low, high = words_of([t.encode() for t in texts])
    plain = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())]
    assert [data[a : a + n].tobytes() for a, n in zip(at, size, strict=True)] == plain
    keys = list(zip(low.tolist(), high.tolist(), strict=True))
    assert len(set(keys)) == len(set(plain)) and len({(k, w) for k, w in zip(keys, plain, strict=True)}) == len(set(plain))


def test_packed_files(spark, docs, empty, tmp_path):
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 70000):
        for x in (rng.integers(0, 49408, n), rng.integers(0, 2**32, n), np.where(rng.random(n) < 0.02, 2**31, rng.integers(0, 3, n)), np.full(n, 7)):
            s = packed_ids.pack(x.astype(np.uint32))
            assert (packed_ids.unpack(*s[:4], np.frombuffer(s[4], np.uint8))[:n] == x).all()
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t, start, want = Tokenizer.from_file(path), 0, collections.Counter()
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert rows_of(packed_ids.round_trip(spark, docs, path, 2)) == want
    many = packed_ids.write(docs, path, 2, f"file://{tmp_path}/f", docs_per_file=40, ids_per_file=900).cache()
    assert many.count() > 5 and rows_of(packed_ids.read(many)) == want
    f = packed_ids.PackedFile(many.orderBy("part", "seq").first()["path"])
    assert (f.ids(130, 300) == f.ids(0, 10**9)[130:300]).all()
    assert packed_ids.round_trip(spark, empty, path, 2).count() == 0


def test_words_are_encoded_as_in_whole_texts():
    path = tokenizer_file("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        w = packed_ids.WordIds(f.read())
    rng = random.Random(1)
    parts = [" ", "\n", "\x0b", "\x1c", "\xa0", " ", "́", "e", "É", "İ", "Σ", "ß", "'s", "'S", "12", "<|endoftext|>", "<|", "日", "👍", "a", "B", ".", "!!", "‍", "µ", "ª", "×", "\x00", "\x00\x00a"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(w.encode([x.encode()])[0], w.kind).tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "idiot", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9001, None), (9002, ""), (None, "no id"), (9003, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, lab).collect()
    truth = dict(labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert toxicity.scored(empty, lab).count() == 0
    assert {r.score for r in toxicity.scored(docs, lab.filter("false")).collect()} == {0.5}


TONGUES = {
    "de": "das haus der königin und der könig war da mit schönen gärten über dem fluß und vielen bäumen ",
    "en": "the house of the king and the queen was there with many gardens over the river and trees ",
    "fr": "la maison de la reine et le roi était là avec des jardins près de la rivière et des arbres ",
}


def brute_languages(pages, docs):
    """Fusion of evidence with Python numbers, page by page."""
    langs = sorted({g for _, _, g in docs if g})

    def grams(t):
        t = " " + " ".join(x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x) + " "
        return [language_id._grams_of(t[i : i + 3]) for i in range(len(t) - 2)] if len(t) > 3 else []

    size = 1 << language_id.BITS
    count = {g: collections.Counter() for g in langs}
    for _, t, g in docs:
        count[g].update(grams(t))
    norm = {g: math.log(sum(count[g].values()) + 0.5 * size) for g in langs}
    seen = []
    for _, url, html in pages:
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<!--.*?-->", " ", re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1[^>]*>", " ", html or "")))
        g = grams(text)
        w = min(1.0, language_id.WEIGHT / math.sqrt(len(g))) if g else 0
        logs = [w * sum(math.log(count[k][x] + 0.5) - norm[k] for x in g) for k in langs]
        top = max(logs)
        m = re.match(r"(?i)[a-z]+://(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = m[1].lower() if m else ""
        d = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html or "")
        own = logs.index(top) if max(logs) > min(logs) else None
        seen.append({"logs": [x - top for x in logs], "own": own, "host": host, "site": ".".join(host.split(".")[-3:]), "suffix": host.split(".")[-1], "declared": d[1].lower() if d else ""})
    out = []
    for i, p in enumerate(seen):
        def counts(key, skip=lambda q: False):
            return [sum(q["own"] == k and (key is None or q[key] == p[key]) and not skip(q) for j, q in enumerate(seen) if j != i) for k in range(len(langs))]

        def share(c, up):
            return [(x + language_id.PRIOR * u) / (sum(c) + language_id.PRIOR) for x, u in zip(c, up, strict=True)]

        c = counts(None)
        base = [(x + 1) / (sum(c) + len(langs)) for x in c]
        prior = share(counts("host"), share(counts("site"), base))
        said = share(counts("declared"), base) if p["declared"] else base
        ending = share(counts("suffix", lambda q: q["site"] == p["site"]), base) if p["suffix"] else base
        z = [t + math.log(a) + math.log(s / b) + math.log(e / b) for t, a, s, e, b in zip(p["logs"], prior, said, ending, base, strict=True)]
        out.append((pages[i][0], langs[z.index(max(z))], 1 / sum(math.exp(x - max(z)) for x in z), p["declared"], p["host"]))
    return out


def test_language_identification(spark, monkeypatch):
    def hashed(t):
        a, b, c = (ord(x) for x in t)
        m = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
        return ((m ^ (m >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - language_id.BITS)

    monkeypatch.setattr(language_id, "_grams_of", hashed, raising=False)
    docs = [(i, t * 4, g) for i, (g, t) in enumerate(list(TONGUES.items()) * 4)]
    train = spark.createDataFrame([*docs, (99, None, "en"), (98, "no label", None)], "doc_id long, text string, lang string")
    rng = random.Random(7)
    pages = []
    for i in range(60):  # hosts of one language with some pages that declare another, and pages that say nothing
        g = ("de", "fr", "en")[i % 3]
        words = rng.sample(TONGUES[g].split(), rng.choice([0, 1, 3, 8]))
        said = rng.choice([g, g, "en", None])
        head = f"<html lang='{said}'>" if said else "<HTML>"
        pages.append((i, rng.choice([f"http://w{i % 4}.{g}-news.example.{'de' if g == 'de' else 'com'}/x", f"https://user@{g}.org:80/a", None]), f"{head}<!-- the the --><script>the king</script><p>{' '.join(words)}</p>"))
    pages += [(100, None, None), (101, "not a url", "the house of the king"), (102, "http://a.example.de/z", "<html lang='en'><style>la la</style>das haus der königin und der könig"), (102, "http://a.example.de/z", "<html lang='en'><style>la la</style>das haus der königin und der könig"), (103, "http://x.fr", "a < b"), (104, "http://x.fr", "<p" * 20000 + " la maison")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("clash")).withColumn("own", F.lit(1))
    got = language_id.identify(df.repartition(3), train).collect()
    want = brute_languages(pages[:-2], docs)  # without the two with signs that open nothing
    rows = [r for r in got if r.page_id not in (103, 104)]
    plain = language_id.identify(df.filter("page_id < 103"), train).collect()
    assert collections.Counter((r.page_id, r.lang, round(r.probability, 6), r.declared, r.host) for r in plain) == collections.Counter((a, b, round(c, 6), d, e) for a, b, c, d, e in want)
    assert len(got) == len(pages) and {r.lang for r in rows if r.page_id == 102} == {"de"}
    monkeypatch.setattr(language_id, "FEW_ROWS", 0)
    monkeypatch.setattr(language_id, "HOT", 5)
    again = language_id.identify(df.repartition(3), train).collect()
    assert collections.Counter((r.page_id, r.lang, round(r.probability, 9)) for r in again) == collections.Counter((r.page_id, r.lang, round(r.probability, 9)) for r in got)
    assert language_id.identify(df.filter("false"), train).count() == 0
    assert {(r.lang, r.probability) for r in language_id.identify(df, train.filter("false")).collect()} == {(None, None)}


def test_more_languages_than_a_block(spark, monkeypatch):
    def hashed(t):
        a, b, c = (ord(x) for x in t)
        m = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
        return ((m ^ (m >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - language_id.BITS)

    monkeypatch.setattr(language_id, "_grams_of", hashed, raising=False)
    rng = random.Random(11)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(12)] for k in range(70)}
    words["l69"] = words["l03"]  # equal languages in the first and the last block: the first by name is taken
    docs = [(k, " ".join(w) + " the king", g) for k, (g, w) in enumerate(words.items())] + [(100 + k, "the house of the king", "l01") for k in range(3)]
    train = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    pages = []
    for k, g in enumerate([*words, *words]):
        said = rng.choice([f"<html lang={'de' if k % 2 else 'en'}>", ""])
        pages.append((k, rng.choice([f"http://w{k % 9}.x{k % 4}.example.{'com' if k % 3 else 'de'}/", None]), said + " ".join(rng.sample(words[g], rng.choice([0, 1, 3, 6])))))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = lambda: collections.Counter((r.page_id, r.lang, round(r.probability, 6), r.declared, r.host) for r in language_id.identify(df, train).collect())
    got = rows()
    assert got == collections.Counter((a, b, round(c, 6), d, e) for a, b, c, d, e in brute_languages(pages, docs))
    assert {b for _, b, *_ in got} > {f"l{k}" for k in range(64, 69)}
    for at_once, waiting, few in ((9, 200, 0), (200, 1 << 22, 1_000_000)):  # many blocks, few pages at once, joins; one block
        monkeypatch.setattr(language_id, "AT_ONCE", at_once)
        monkeypatch.setattr(language_id, "WAITING", waiting)
        monkeypatch.setattr(language_id, "FEW_ROWS", few)
        monkeypatch.setattr(language_id, "HOT", 5)
        assert rows() == got


def test_text_of_pages_is_linear():
    import time

    for page in (b"<script>" * 200_000, b"<!-- " * 300_000, b"<p " * 400_000, b"<style><script>" * 100_000 + b"</style>text"):
        start = time.time()
        language_id.visible(page)
        assert time.time() - start < 3
    assert language_id.visible(b"a<b>c</b><SCRIPT x>if (a > b)</Script >d<!-- <p> -->e<styled>f").split() == [b"a", b"c", b"d", b"e", b"f"]


def test_pieces(docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for r in ROWS:
        ids = sp.encode(r[1] or "")
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    assert rows_of(prefix_bpe.digests(docs, path)) == want
    assert prefix_bpe.digests(empty, path).count() == 0
    back = {(r.doc_id, r.text) for r in prefix_bpe.decode(prefix_bpe.encode(docs, path), path).collect()}
    assert back == {(r[0], sp.decode(sp.encode(r[1] or ""))) for r in ROWS}
    table, rng = prefix_bpe.PrefixTable(prefix_bpe.load_vocabulary(path)), random.Random(4)
    for x in ("x" * 30_000, "ab" * 20_000 + " tail", "\u00fc" * 5000, "1" * 9000):  # long words without a break
        assert table.encode(x) == sp.encode(x) and table.digest(x)[2] == sha(sp.decode(sp.encode(x)))
    parts = [" ", "  ", "▁", "\n", "\t", "a", "the", "é", "€", "𝔘", "1", "<s>", "<0x41>", "in", "ing", "er", "日本", "=", "\x00", "{", " t", ".", ",", "-", "'s", "...", "ü", "Z", ")", "?!", "ſ", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [" " * k + s for k in range(1, 80) for s in ("", "x", ".")]
    for x in texts:
        assert table.encode(x) == sp.encode(x), repr(x)


def test_fingerprints(spark, docs, empty):
    own = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string").repartition(3)
    order = sorted([(r[0], r[1] or "") for r in ROWS], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        u, h = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()] += 1
    for each in (8192, 20):
        got = fingerprints.edited_pairs(docs, each).collect()
        assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(own).collect()}
    assert {(r.doc_id, r.fingerprint) for r in got} == plain
    by_text = collections.defaultdict(set)
    texts = collections.defaultdict(set)
    for r in ROWS:
        texts[r[0]].add(r[1] or "")
    for i, f in plain:
        if len(texts[i]) == 1:
            by_text[next(iter(texts[i]))].add(f)
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r.near_edited for r in got if r.n_chars > 200]) > 0.2 > 5 * np.mean([r.near_next for r in got if r.n_chars > 200])
    assert fingerprints.edited_pairs(empty).count() == 0
    one = fingerprints.edited_pairs(own.filter("doc_id = 5")).first()
    assert one.near_next == 1


def plain_phrases(x, mask=(1 << 64) - 1):
    """One level of the parsing, name by name with Python numbers."""
    def mix(v):
        v = ((v ^ (v >> 32)) * 0xD6E8FEB86659FD93) & mask
        v ^= v >> 29
        v = (v * 0xA0761D6478BD642F) & mask
        return v ^ (v >> 32)

    runs = []
    for v in x:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    x = [mix(v ^ (n * 0xC2B2AE3D27D4EB4F & mask)) if n > 1 else v for v, n in runs]

    def toss(before, v, first):
        d = 1 if first or before == v else before ^ v
        low = d & -d
        return 2 * (low.bit_length() - 1) + ((v & low) > 0)

    label = [toss(x[i - 1] if i else 0, v, i == 0) for i, v in enumerate(x)]
    for _ in range(3):
        label = [toss(label[i - 1] if i else 0, v, i == 0) for i, v in enumerate(label)]
    out, held = [], []
    for i, v in enumerate(x):
        top = i and label[i] > label[i - 1] and (i + 1 == len(x) or label[i] > label[i + 1])
        if top:
            out.append(held)
            held = []
        held.append(v)
    out.append(held)
    return [mix((sum(mix((v + k * 0x9E3779B97F4A7C15) & mask) for k, v in enumerate(p)) + len(p)) & mask) for p in out]


def plain_names(text):
    mask = (1 << 64) - 1
    x, found = [int(fingerprints._BYTES[b]) for b in text], []
    for level in range(1, 99):
        x = plain_phrases(x, mask)
        if level > 1:
            found += [v >> 32 for v in x]
            if len(x) == 1:
                return found


def test_parsing_against_a_plain_version():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(25)] + ["aaaaaaaaab", "abababab", "x", "Ü" * 9, "aab" * 30]
    together = fingerprints.names([t.encode() for t in texts])
    for t, got in zip(texts, together, strict=True):
        assert got.tolist() == plain_names(t.encode()), t


def test_likeness_estimates_the_share_of_names(spark):
    rng = random.Random(13)
    core = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(500)]
    rows = [(i, " ".join(core[: 500 - 40 * i] + [f"new{rng.randint(0, 999)}" for _ in range(40 * i)])) for i in range(9)]
    df = spark.createDataFrame([*rows, (50, None)], "doc_id long, text string")
    every = {r.doc_id: set(r.names) for r in fingerprints.phrase_names(df).collect()}
    short = {r.doc_id: fingerprints.from_text(r.fingerprint) for r in fingerprints.fingerprints(df).collect()}
    assert every[50] == set()
    for i in range(1, 9):
        true = len(every[0] & every[i]) / len(every[0] | every[i])
        assert abs(fingerprints.likeness(short[0], short[i]) - true) < 4 * max(0.02, math.sqrt(true * (1 - true) / fingerprints.KEPT))
    whole = fingerprints.sketches([rows[0][1].encode(), rows[3][1].encode()], 0)
    assert fingerprints.likeness(*whole, 0) == len(every[0] & every[3]) / len(every[0] | every[3])


def test_interior_signatures_do_not_depend_on_the_offset():
    rng = random.Random(6)
    core = " ".join(rng.choice(WORDS) for _ in range(400))
    inner = set(fingerprints.names([core.encode()])[0].tolist())
    for k in (1, 2, 3, 17, 255):
        moved = set(fingerprints.names([("z" * k + "q" + core + "end").encode()])[0].tolist())
        assert len(inner & moved) / len(inner) > 0.9
    t = core.encode()
    assert (fingerprints.names([t])[0] == fingerprints.names([b"aa", t, b"", b"bb bb"])[1]).all()


def brute_components(rows, k, num=80, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(rows[i][0], len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_near_duplicates(docs, empty):
    want = collections.Counter(brute_components([r[:2] for r in ROWS], 4))
    got = near_dedup.near_duplicates(docs, k=4)
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(9)
    core = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(150)]
    rows = [(0, " ".join(core))]
    for i in range(1, 400):
        w = list(core)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=4).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(brute_components(rows, 4))


def test_a_shortened_copy_of_a_shortened_copy(spark, monkeypatch):
    # without the luck of neighbours, the exact join must find what is apart from a pivot of another size
    monkeypatch.setattr(near_dedup, "neighbour_pairs", lambda *_: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(near_dedup, "SPLIT", 7)
    rng = random.Random(4)
    core = [f"w{i}" for i in range(127)]
    rows = [(0, " ".join(core))]
    for i in range(1, 61):
        w = list(core)
        for at in rng.sample(range(127), 3):
            w[at] = f"new{i}x{at}"
        rows.append((i, " ".join(w)))
    for i in range(3):  # 115 of 127 words, and 100 of these: too few to be like the whole
        less = rng.sample(core, 115)
        rows += [(4000 + i, " ".join(less)), (5000 + i, " ".join(less[:100]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=1).collect()
    assert [r.doc_id for r in got if r.component_id != 0] == []


def base_spans(t):
    e, i, c, p = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))

    def luhn(v):
        d = [int(x) for x in v if x.isdigit()][::-1]
        return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0

    checks = (("email", e, lambda v: True), ("ip", i, lambda v: all(int(x) <= 255 for x in v.split("."))), ("card", c, luhn), ("phone", p, lambda v: 8 <= sum(x.isdigit() for x in v) <= 15))
    return [[f"{k}:{m.start()}:{m.end()}" for m in rx.finditer(t) if ok(m[0])] for k, rx, ok in checks]


def test_private_data(spark, empty):
    rng = random.Random(5)
    parts = [*"0123456789" * 2, ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "4111111111111111", "1.2.3.4", "x@y.zz", "_", "é", "\n", "😀", "256", "00", "+1 (555) 123-4567", " phone "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(1200)]
    rows += [(5000, None), (5001, "9" * 30000), (5002, "a." * 20000), (5003, "1 " * 20000), (5004, "x@y.zz " * 300), (None, "me@there.org"), (7, "me@there.org"), (5005, "reference 1234 4111111111111111 here")]
    got = private_data.found(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3)).collect()
    want, texts = collections.Counter(), collections.defaultdict(list)
    for i, t in rows:
        b = base_spans(t or "")
        want[i, *map(len, b), hashlib.sha256(",".join(s for k in b for s in k).encode()).hexdigest()] += 1
        texts[i].append(t or "")
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        spans = set(r.spans.split(","))
        assert any({s for k in base_spans(t) for s in k} <= spans for t in texts[r.doc_id])
    assert "card:15:31" in next(r.spans for r in got if r.doc_id == 5005)
    assert private_data.found(empty).count() == 0
    out = private_data.redacted(spark.createDataFrame([(1, "mail a@b.cc and 1.2.3.4, +1 (555) 123-4567.", 9, "k"), (2, None, None, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, size string")).collect()
    assert [(r.text, r.size) for r in sorted(out)] == [("mail [EMAIL] and [IP], [PHONE].", "k"), (None, "k"), ("clean", "k")] and sorted(out)[0].n_chars == 31


def test_cards_written_digit_by_digit(spark):
    rows = [(1, "pay " + " ".join("4111111111111111") + " now"), (2, "-".join("4111111111111111")), (3, " ".join("4111111111111112"))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in private_data.found(table).collect()}
    for i, t in rows:
        b = base_spans(t)
        assert got[i].n_card == len(b[2]) == int(i < 3)
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for k in b for s in k).encode()).hexdigest()
    assert {r.doc_id: r.text for r in private_data.redacted(table).collect()} == {1: "pay [CARD] now", 2: "[CARD]", 3: rows[2][1]}


def brute_top(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    for q, v in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            want.update((q, n + 1, i, max(-(2**63), min(2**63 - 1, -x))) for n, (x, i) in enumerate(s))
    return want


def test_vector_file(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.3, 16)]) for i in range(400)]
    rows += [(1000, [0.1] * 16), (1001, [0.1] * 16), (1050, None), (1051, [None] + [0.1] * 15), (1052, [float("nan")] * 16), (1053, [float("inf")] * 16), (1100, [0.5] * 3), (1101, [0.2] * 3), (None, [0.1] * 16), (77, rows[77][1]), (1150, []), (1151, [])]
    rows += [(100, rows[3][1]), (150, rows[150][1]), (150, rows[150][1])]  # query ids with other and with equal rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("cells", F.lit(1))
    assert rows_of(vector_file.top_k(df.repartition(3))) == brute_top(rows)
    assert vector_file.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(vector_file, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(vector_file, "ROWS_EACH", 40)
    rng = np.random.default_rng(3)
    rows = [(2, [20000.0, 20000.0]), (50, [20000.0, 1.0]), (51, [-1e9, 3e8]), (100, [1e12, -1e7]), (101, [1e200, 1e-200]), (150, [-3e250, 7.0]), (200, [0.25, 0.5]), (250, [-1e300, 1e300])]
    rows += [(int(i), [float(x) for x in rng.normal(0, 10.0 ** rng.integers(-2, 8), 2)]) for i in range(300, 700)]
    got = vector_file.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert rows_of(got) == brute_top(rows)


def test_few_records_are_read(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.3, (4000, 16))
    edges = vector_file.Edges(np.floor(256 * v).min(axis=0), np.quantile(np.floor(256 * v), np.arange(1, 16) / 16, axis=0).T, np.floor(256 * v).max(axis=0))
    x = np.floor(256 * v)
    block = vector_file.Block([0], [0], [x[0].tolist()], edges)
    low, high = block.bounds(edges.cells(x))
    score = x @ x[0]
    assert (low[0] <= score).all() and (score <= high[0]).all()
    assert (high[0] >= np.sort(low[0])[-5]).mean() < 0.15  # what the scan leaves to be read


def test_mixing(spark, docs, empty):
    got = mixing.mixed_sizes(docs, block_words=64, shard_words=1000)
    rows = got.collect()
    assert rows_of(got.select("doc_id", "taken", F.col("shards").cast("string"))) == rows_of(mixing.mixed_sizes(docs, block_words=64, shard_words=1000).select("doc_id", "taken", F.col("shards").cast("string")))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((r[0], size(r[1])) for r in ROWS)
    total = collections.Counter()
    for r in ROWS:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    of = {(r[0], size(r[1])): r[3] for r in ROWS}
    taken = collections.Counter()
    for r in rows:
        s = of[r.doc_id, r.size]
        assert math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == total[s] and r.taken <= 3 * r.size
        taken[s] += r.taken
    # half of the shortest row of a source is the most that can be missing, or all where every row is longer
    least = {s: min(size(r[1]) for r in ROWS if r[3] == s and size(r[1])) for s in names if total[s]}
    assert all(abs(taken[s] - target[s]) <= max(30, least[s], 0.02 * target[s]) for s in least) and mixing.mixed_sizes(empty).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns


def test_mixing_past_a_long_row(spark):
    sizes = [("a", 25)] * 300 + [("a", 6000)] + [("b", 40)] * 300
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    for seed in (1, 2):
        got = mixing.mixed_sizes(table, seed=seed, block_words=64, shard_words=5000).collect()
        for s, least in (("a", 25), ("b", 40)):
            own = [r for r in got if sizes[r.doc_id][0] == s]
            target, taken = own[0].target, sum(r.taken for r in own)
            passes = target // own[0].source_size
            # the long row is taken as often as any other or once less; small rows close the rest to half of one
            assert all(r.taken // r.size in (passes, passes + 1) and len(r.shards) == r.taken // r.size for r in own)
            assert abs(taken - target) <= least / 2, (seed, s, taken, target)


def test_mixing_leaves_no_row_that_fits(docs):
    for seed in (17,):
        rows = [r for r in mixing.mixed_sizes(docs, seed=seed, block_words=64, shard_words=1000).collect() if r.size]
        by_source = collections.defaultdict(list)
        for r in rows:  # the sums of all sources differ
            by_source[r.source_size].append(r)
        assert len(by_source) >= 5
        for total, own in by_source.items():
            missing = own[0].target - sum(r.taken for r in own)
            passes = own[0].target // total
            assert not any(r.taken == passes * r.size and abs(r.size - missing) < abs(missing) - 1e-6 for r in own), (seed, missing)


def test_splitting_tree(spark):
    q = spark.createDataFrame([([30, 0, 5, 17],)], "k array<bigint>")
    for n in (1, 2, 7, 8):
        rows = mixing.split_tree(q, n, 3).collect()
        assert sorted(r.shard for r in rows) == list(range(n)) and np.sum([r.k for r in rows], axis=0).tolist() == [30, 0, 5, 17]
        assert max(sum(r.k) for r in rows) - min(sum(r.k) for r in rows) <= 1
    h = spark.range(20000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), mixing._uniform(F.col("id"))).alias("x")).groupBy("x").count().collect()
    for r in h:
        assert abs(r["count"] / 20000 - math.comb(20, r.x) * math.comb(30, 10 - r.x) / math.comb(50, 10)) < 0.015
