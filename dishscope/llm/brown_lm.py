"""Class-based n-gram scoring: word classes by exchange clustering.

Words are ASCII-lower-cased runs without white space; a text is its words and one
end.  The vocabulary is every word that training texts hold ``LEAST`` times, as far as
``MOST`` words fit on a worker; its classes are learnt in two steps.  The most frequent
words, and spelling groups that stand for all others, are clustered by exchange: each
is moved to the class that raises the likelihood of the class bigrams most, until
nothing moves.  Then every other word of the vocabulary, from its counts beside the
classes over all training texts, is put into the class of greatest exchange gain.  Only
words outside the vocabulary keep their spelling group.  A word's probability after
another is

    0.9 * P(class | class before) * P(word | class) + 0.1 * P(word)

where a word outside the vocabulary has P(group | class) * P(word | group), and each
group keeps a share for words not seen.  All counts are over all training texts.

Texts are cut into words twice: to count them, and to write their numbers, from which
all later passes read.  What comes to the driver is bounded by parameters: the
vocabulary, and the bigram counts of ``UNITS`` units.  Counts of words outside the
vocabulary stay in a table and are joined to the texts that hold them.

Null texts count as empty (an end alone).  Rows with a null doc_id are trained on
and not held out.  Without training texts every probability is 1 of 1.  Repeated rows
have equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, remainder
from .words import KeyTable, distinct, joined, words

CLASSES, SHAPES, UNITS = 64, 72, 2048
#: Words clustered one by one, and the unit of the end.
CORE, END = UNITS - SHAPES - 1, UNITS - 1
#: Least count of a word of the vocabulary, and its most words.
LEAST, MOST = 5, 1 << 20
PASSES, SHARE, PRIOR = 100, 0.9, 5.0
REMEMBERED = 300_000
#: Bytes of text, or numbers, handled at once.
STRETCH = 1 << 20

_CLOSER = np.zeros(256, bool)
_CLOSER[list(b".,;:!?\"')")] = True
_LETTER = np.full(256, 35, np.int64)
_LETTER[97:123] = np.arange(26)


def shapes_of(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spelling group of each word, 0..SHAPES-1: digits, letters beyond ASCII, else the last letter; and a closing mark."""
    if not len(at):
        return np.zeros(0, np.int64)
    last = at + size - 1
    closed = _CLOSER[text[last]] & (size > 1)
    end = text[last - closed]
    has = lambda flag: np.add.reduceat(flag.view(np.int8), at, dtype=np.int32) > 0
    kind = np.where(has((text >= 48) & (text <= 57)), 34, _LETTER[end])
    kind = np.where(has(text >= 128), 26 + (text[at].astype(np.int64) * 7 + end) % 8, kind)
    return 2 * kind + closed


def stretches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of a column, so many that they are about ``STRETCH`` bytes."""
    a, held, size = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or b""
        if held and size + len(t) > STRETCH:
            yield a, held
            a, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield a, held


class Vocabulary:
    """Numbers of the vocabulary's words by key, with their counts and spelling groups."""

    def __init__(self, names: list[bytes], counts: np.ndarray):
        text, at, size, low, high = words(joined([b" ".join(names)])[0])
        self.low, self.high = low, high
        self.counts, self.shapes = counts.astype(np.int64), shapes_of(text, at, size).astype(np.int8)
        self.table: tuple[KeyTable, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.counts)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}

    def numbers(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, -1 outside the vocabulary."""
        if self.table is None:
            table = KeyTable(max(10, (2 * len(self)).bit_length()))
            number = np.zeros(table.slots, np.int32)
            number[table.put(self.low, self.high)] = np.arange(len(self), dtype=np.int32)
            self.table = table, number
        table, number = self.table
        slot = table.find(low, high)
        return np.where(slot >= 0, number[slot], -1)


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit from the counts of unit pairs (before, after), moved until nothing moves."""
    n = len(pairs)
    counts = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-counts, kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    onto = np.zeros((n, classes))  # pairs of a unit and a class after it
    into = np.zeros((classes, n))
    for c in range(classes):
        onto[:, c] = pairs[:, of == c].sum(axis=1)
        into[c] = pairs[of == c].sum(axis=0)
    both = np.zeros((classes, classes))
    np.add.at(both, of, onto)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    diagonal = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for w in order:
            if counts[w] == 0:
                continue
            a, s = of[w], float(pairs[w, w])
            r, left = onto[w].copy(), into[:, w].copy()
            r[a] -= s
            left[a] -= s
            both[a] -= r
            both[:, a] -= left
            both[a, a] -= s
            fb = f(both)
            rows, columns = both.sum(axis=1), both.sum(axis=0)
            # only columns with pairs of this unit change
            some, here = np.nonzero(r)[0], np.nonzero(left)[0]
            down, across = f(both[:, some] + r[some]) - fb[:, some], f(both[here] + left[here, None]) - fb[here]
            gain = down.sum(axis=1) + across.sum(axis=0)
            gain[some] -= down[some, np.arange(len(some))]
            gain[here] -= across[np.arange(len(here)), here]
            d = both[diagonal, diagonal]
            gain += f(d + r + left + s) - fb[diagonal, diagonal]
            # pairs before and after the unit count in all rows and columns, whatever its class
            rows, columns = rows + left, columns + r
            gain -= f(rows + r.sum() + s) - f(rows) + f(columns + left.sum() + s) - f(columns)
            c = int(np.argmax(gain))
            if gain[c] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                c = int(a)
            both[c] += r
            both[:, c] += left
            both[c, c] += s
            if c != a:
                of[w] = c
                moved += 1
                onto[:, a] -= pairs[:, w]
                onto[:, c] += pairs[:, w]
                into[a] -= pairs[w]
                into[c] += pairs[w]
        if not moved:
            break
    return of


def insertion_gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, both: np.ndarray) -> np.ndarray:
    """(words, classes): what the likelihood of the class pairs ``both`` gains by each class for words with pairs ``left`` and ``right`` of classes.

    ``own`` is the class a word is counted in; its gain is what would be lost by taking the word out.
    """
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    # with the word in: class pairs grow, for its own class they are as they stand
    k = np.arange(len(own))
    base = np.broadcast_to(both, (len(own), *both.shape)).copy()
    base[k, :, own] = np.maximum(base[k, :, own] - left, 0)
    base[k, own, :] = np.maximum(base[k, own, :] - right, 0)
    gain = (f(base + left[:, :, None]) - f(base)).sum(axis=1) + (f(base + right[:, None, :]) - f(base)).sum(axis=2)
    d = base[:, np.arange(both.shape[0]), np.arange(both.shape[0])]  # a class beside itself grows by both
    gain += f(d + left + right) - f(d + left) - f(d + right) + f(d)
    rows, columns = base.sum(axis=2) + left, base.sum(axis=1) + right
    more, less = right.sum(axis=1, keepdims=True), left.sum(axis=1, keepdims=True)
    return gain - (f(rows + more) - f(rows)) - (f(columns + less) - f(columns))


def _texts(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = KeyTable(20), np.zeros(1 << 20, np.int64)
        names: list[bytes] = []
        counts = np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts)], ["word", "n"])

        for batch in batches:
            for _, some in stretches(batch.column(1)):
                text, at, size, low, high = words(joined(some)[0])
                slot = table.find(low, high)
                new = np.nonzero(slot < 0)[0]
                if len(new):
                    first = new[distinct(low[new], high[new])]
                    number[table.put(low[first], high[first])] = len(names) + np.arange(len(first))
                    data = text.tobytes()
                    names += [data[a:b] for a, b in zip(at[first].tolist(), (at[first] + size[first]).tolist(), strict=True)]
                    slot[new] = table.find(low[new], high[new])
                    counts = np.concatenate([counts, np.zeros(len(names) - len(counts), np.int64)])
                counts += np.bincount(number[slot], minlength=len(counts))
                if len(names) > REMEMBERED:
                    yield out()
                    table.clear()
                    names, counts = [], np.zeros(0, np.int64)
        yield out()

    return texts.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, least: int, most: int) -> tuple[Vocabulary, int]:
    """(the words with a count of at least a limit, the limit): the least limit from ``least`` up that ``most`` words reach."""
    by_count = counts.filter(F.col("n") >= least).groupBy("n").agg(F.count(F.lit(1)).alias("k")).toArrow()  # a row for each different count
    n, k = by_count.column("n").to_numpy(), by_count.column("k").to_numpy()
    order = np.argsort(-n)
    fits = np.cumsum(k[order]) <= most
    limit = int(n[order][fits].min()) if fits.any() else int(n.max(initial=least - 1)) + 1
    found = counts.filter(F.col("n") >= limit).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Vocabulary(found.column("word").to_pylist(), found.column("n").to_numpy()), limit


def encoded(texts: DataFrame, shared) -> DataFrame:
    """doc_id, held, n_tokens, ids (int32: numbers of words, -1 - group outside the vocabulary), far, times (words outside it, each once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_: Vocabulary = shared.value
        for batch in batches:
            for a, some in stretches(batch.column(1)):
                data, first = joined(some)
                text, at, size, low, high = words(data)
                ids = vocabulary_.numbers(low, high)
                rare = np.nonzero(ids < 0)[0]
                groups = shapes_of(text, at, size)
                ids = np.where(ids >= 0, ids, -1 - groups).astype("<i4")
                upto = np.searchsorted(at, first)
                plain = text.tobytes()
                names = [plain[p:q] for p, q in zip(at[rare].tolist(), (at[rare] + size[rare]).tolist(), strict=True)]
                cut = np.searchsorted(rare, upto).tolist()
                far = [Counter(names[p:q]) for p, q in zip(cut[:-1], cut[1:], strict=True)]
                raw = ids.tobytes()
                part = batch.slice(a, len(some))
                columns = [
                    part.column(0),
                    part.column(2),
                    pa.array(np.diff(upto) + 1),
                    pa.array([raw[4 * p : 4 * q] for p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.binary()),
                    pa.array([list(c.keys()) for c in far], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in far], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held", "n_tokens", "ids", "far", "times"])

    return texts.select("doc_id", "text", "held").mapInArrow(run, "doc_id long, held boolean, n_tokens long, ids binary, far array<binary>, times array<long>")


def streams(batches: Iterator[pa.RecordBatch], column: int, end: int, limit: int = STRETCH) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, numbers with ``end`` behind each text and one before all, where each text's numbers start) of some rows at a time."""
    for batch in batches:
        a, size = 0, 0
        lengths = [len(x) // 4 for x in batch.column(column).to_pylist()]
        for i in range(batch.num_rows + 1):
            if i == batch.num_rows or (i > a and size + lengths[i] > limit):
                part = batch.slice(a, i - a)
                mark = np.array([end], "<i4").tobytes()
                data = np.frombuffer(mark + mark.join([*part.column(column).to_pylist(), b""]), "<i4")
                own = np.array(lengths[a:i], np.int64) + 1
                yield part, data, 1 + np.cumsum(own) - own
                a, size = i, 0
            if i < batch.num_rows:
                size += lengths[i]


#: Stands for the end among numbers of words.
_END = np.int32(2**31 - 1)


def _units(ids: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The clustered unit of each number: a core word, a spelling group, or the end."""
    inside = (ids >= 0) & (ids != _END)
    group = np.where(inside, shapes[np.where(inside, ids, 0)] if len(shapes) else 0, -1 - ids)
    return np.where(ids == _END, END, np.where(inside & (ids < CORE), ids, CORE + group)).astype(np.int64)


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum by code of the rows (code, n) that ``run`` gives; at most ``size`` of them come to the driver."""
    found = rows.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out


def _counts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    code = np.nonzero(total)[0]
    for a in range(0, len(code), 100_000):
        some = code[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["code", "n"])


def pair_counts(training: DataFrame, shared, size: int, of=None) -> np.ndarray:
    """size x size counts of neighbours over all texts: of units, or of their classes where ``of`` gives these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shapes = np.zeros(size * size, np.int64), shared.value.shapes
        for _, ids, _ in streams(batches, 0, _END):
            unit = _units(ids, shapes) if of is None else of.value(ids)
            total += np.bincount(unit[:-1] * size + unit[1:], minlength=size * size)
        yield from _counts(total)

    return _summed(training.select("ids"), run, size * size).reshape(size, size)


class Classes:
    """Class of every number: of words, of spelling groups, of the end."""

    def __init__(self, of_words: np.ndarray, of_groups: np.ndarray, of_end: int):
        self.of_words, self.of_groups, self.of_end = of_words.astype(np.int8), of_groups.astype(np.int8), of_end

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        inside = (ids >= 0) & (ids != _END)
        of = self.of_words[np.where(inside, ids, 0)] if len(self.of_words) else 0
        return np.where(inside, of, np.where(ids == _END, self.of_end, self.of_groups[np.where(ids < 0, -1 - ids, 0)])).astype(np.int64)


def inserted(training: DataFrame, shared, classes, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, classes) of the vocabulary's words beyond the core, by exchange gain over their neighbours in all texts."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((code >> 7).astype(np.int32)), pa.array((code & 127).astype(np.int16)), pa.array(n.astype(np.int64))], ["word", "beside", "n"])

        for _, ids, _ in streams(batches, 0, _END):
            of = classes.value(ids)
            at = np.nonzero((ids >= CORE) & (ids != _END))[0]
            word = ids[at].astype(np.int64) << 7
            held += [word | of[at - 1], word | CLASSES | of[at + 1]]
            size += 2 * len(at)
            if size > 1 << 22:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    table = training.select("ids").mapInArrow(neighbours, "word int, beside short, n long").groupBy("word", "beside").agg(F.sum("n").alias("n"))
    table = table.groupBy("word").agg(F.collect_list(F.struct("beside", "n")).alias("x"))  # at most 128 a word

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                word, x = part.column(0).to_numpy(), part.column(1)
                row = np.repeat(np.arange(len(word)), np.diff(x.offsets.to_numpy()))
                beside, n = (x.flatten().field(i).to_numpy() for i in (0, 1))
                counts = np.zeros((len(word), 2 * CLASSES))
                counts[row, beside] = n
                own = classes.value(word)
                gain = insertion_gains(counts[:, :CLASSES], counts[:, CLASSES:], own, both)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.argmax(gain, axis=1).astype(np.int16))], ["word", "class"])

    found = table.mapInArrow(choose, "word int, class short").toArrow()  # at most MOST rows
    return found.column("word").to_numpy(), found.column("class").to_numpy()


class Model:
    """What scoring needs on every worker."""

    def __init__(self, vocabulary_: Vocabulary, classes: Classes, both: np.ndarray, n_docs: int, n_tokens: int, n_words: int, group_mass: np.ndarray, group_kinds: np.ndarray):
        self.classes, self.counts, self.n_docs = classes, vocabulary_.counts, n_docs
        mass = both.sum(axis=0)  # tokens of each class, the end among them
        members = np.bincount(classes.of_words, minlength=CLASSES) + np.bincount(classes.of_groups, minlength=CLASSES)
        members[classes.of_end] += 1
        whole = mass + 0.1 * members
        self.emit = (self.counts + 0.1) / whole[classes.of_words] if len(self.counts) else np.zeros(0)
        self.emit_end = (n_docs + 0.1) / whole[classes.of_end]
        # a group's share of its class, divided among its words by their counts
        self.emit_group = (group_mass + 0.1) / whole[classes.of_groups] / (group_mass + 0.1 * (group_kinds + 1))
        prior = whole / whole.sum()
        self.step = (both + PRIOR * prior) / (both.sum(axis=1, keepdims=True) + PRIOR)
        self.spread = n_tokens + 0.1 * (n_words + 1)

    def logs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of the model's probability, of the count plus 0.1, whether known) of each number but the first, after the one before it.

        For words outside the vocabulary the first is without its factor of the count
        plus 0.1, which the second lacks too: those come from the table of counts.
        """
        of = self.classes(ids)
        ahead, ids = self.step[of[:-1], of[1:]], ids[1:]
        far, end = ids < 0, ids == _END
        place = np.where(far | end, 0, ids)
        count = np.where(end, self.n_docs, self.counts[place] if len(self.counts) else 0)
        emit = np.where(end, self.emit_end, self.emit[place] if len(self.counts) else 0.0)
        per = SHARE * ahead * np.where(far, self.emit_group[np.where(far, -1 - ids, 0)], emit)
        per += (1 - SHARE) * np.where(far, 1.0, count + 0.1) / self.spread
        return np.log10(per), np.where(far, 0.0, np.log10(count + 0.1)), ~far & (count > 0)


def trained(rows: DataFrame, counts: DataFrame, shared, limit: int, n_docs: int, n_tokens: int, n_words: int) -> Model:
    """The model from the encoded texts that are not held out."""
    spark, vocabulary_ = rows.sparkSession, shared.value
    training = rows.filter("not held")
    of = exchange(pair_counts(training, shared, UNITS))
    core = min(CORE, len(vocabulary_))
    groups = of[CORE : CORE + SHAPES]
    of_words = np.concatenate([of[:core], groups[vocabulary_.shapes[core:]]])
    classes = Classes(of_words, groups, int(of[END]))
    if len(vocabulary_) > core:
        known = spark.sparkContext.broadcast(classes)
        both = pair_counts(training, shared, CLASSES, known)
        number, best = inserted(training, shared, known, both)
        of_words[number] = best
        classes = Classes(of_words, groups, int(of[END]))
    both = pair_counts(training, shared, CLASSES, spark.sparkContext.broadcast(classes))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SHAPES, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 50_000):
                part = batch.slice(a, 50_000)
                text, at, size, _, _ = words(joined([b" ".join(part.column(0).to_pylist())])[0])
                group = shapes_of(text, at, size)
                total[:SHAPES] += np.bincount(group, part.column(1).to_numpy(), SHAPES).astype(np.int64)
                total[SHAPES:] += np.bincount(group, minlength=SHAPES)
        yield from _counts(total)

    rare = _summed(counts.filter(F.col("n") < limit).select("word", "n"), kinds, 2 * SHAPES)
    return Model(vocabulary_, classes, both, n_docs, n_tokens, n_words, rare[:SHAPES], rare[SHAPES:])


def scored(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown-lm")
    texts = _texts(docs)
    training = texts.filter(~F.col("held"))
    counts = scratch.table(word_counts(training), "words")
    n_docs = training.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_tokens, n_words = totals[0] + n_docs, totals[1] + (n_docs > 0)
    vocabulary_, limit = vocabulary(counts, least, most)
    shared = spark.sparkContext.broadcast(vocabulary_)
    rows = scratch.table(encoded(texts, shared).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = spark.sparkContext.broadcast(trained(rows, counts, shared, limit, n_docs, n_tokens, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for part, ids, first in streams(batches, 1, _END):
            if not part.num_rows:
                continue
            score, base, known = (np.add.reduceat(x, first - 1, dtype=np.float64) for x in m.logs(ids))
            columns = [part.column(0), *part.columns[2:], pa.array(score), pa.array(base), pa.array(known.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held", "n_tokens", "score", "base", "known"])

    near = rows.select("row", "ids", "doc_id", "held", "n_tokens").mapInArrow(run, "row long, doc_id long, held boolean, n_tokens long, score double, base double, known long")
    far = rows.select("row", F.explode(F.arrays_zip("far", "times")).alias("f")).select("row", F.col("f.far").alias("word"), F.col("f.times").alias("times"))
    log = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs")
    found = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found")
    logs = far.join(counts.filter(F.col("n") < limit), "word", "left").groupBy("row").agg(log, found)
    out = near.join(logs, "row", "left").withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    spread = float(np.log10(n_tokens + 0.1 * (n_words + 1)))
    return out.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("score") + F.col("logs")).alias("score"),
    )
