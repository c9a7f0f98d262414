"""SentencePiece BPE by a table of last tokens.

Every prefix of a text has one encoding, hence one last token.  Going through
the text once, an automaton names the pieces that end at each position; of
these, the last token is the one that can follow the last token of the prefix
before it, i.e. whose pair with it is its own encoding.  The ids are then read
off the table from the end.  Work is linear in the text, whatever its words.

``encode``/``decode`` on documents with null text count as empty: no ids, and
an empty decoded text.  Rows are handled one by one: repeated ids or texts give
repeated rows, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

SPACE = "▁"
LETTERS = "".join(chr(c) for c in range(0x30, 0x180) if chr(c).isalnum())
MARKS = ".,;:!?)'\"-"
#: Units kept per worker, with their ids, in each of two generations.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 48
PAIRS_REMEMBERED = 1_000_000


def load_vocabulary(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, with kind normal, byte, control, unknown or unused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ((model.is_byte, "byte"), (model.is_control, "control"), (model.is_unknown, "unknown"), (model.is_unused, "unused"))
    out = []
    for i in range(model.get_piece_size()):
        out.append((model.id_to_piece(i), model.get_score(i), next((k for f, k in kinds if f(i)), "normal")))
    return out


class PrefixTable:
    """Encoder and decoder for a BPE vocabulary with byte fallback, a leading space mark and no text normalisation."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        import ahocorasick

        self.pieces = [p for p, _, _ in vocabulary]
        self.kind = "H" if len(vocabulary) <= 65536 else "I"
        self.ids = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "normal"}
        self.score = {p: s for p, s, kind in vocabulary if kind == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.surface = [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else p.replace(SPACE, " ").encode() for p, _, kind in vocabulary]
        self.chars = {p for p in self.ids if len(p) == 1}
        runs = [p for p in self.ids if len(p) > 1 and SPACE in p[1:]]
        if any(set(p) != {SPACE} for p in runs) or len(self.bytes) != 256:
            raise ValueError("a vocabulary with byte pieces is needed, with space marks inside runs of them only")
        # runs of space marks merge after all else; words may hold one mark, at their start
        self.late = max((self.score[p] for p in runs), default=float("-inf"))
        if any(s <= self.late for p, s in self.score.items() if len(p) > 1 and p not in runs):
            raise ValueError("runs of space marks must have the lowest scores")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p not in runs:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        free = "\n" not in self.chars  # a line end that no piece holds is a unit of its own
        rest = f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if free else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        # no piece holds a letter or digit before these marks, so nothing merges across: words end there
        before = {(a, b) for p in self.ids for a, b in zip(p[:-1], p[1:], strict=True)}
        marks = "".join(b for b in MARKS if not any((a, b) in before for a in LETTERS))
        ends = f"{SPACE}*[{LETTERS}]++(?=[{re.escape(marks)}])|" if marks else ""
        self.units = re.compile(ends + rest).findall
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Merge by score, leftmost first on ties, until no pair is a piece: for short texts, as in a pair test."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether (before, token) is the encoding of its own text; ``before`` -1 stands for the start."""
        key = (before + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_REMEMBERED:
                self.pairs.clear()
            b = self.pieces[token]
            known = self.merged(b) == [b] if before < 0 else self.merged(self.pieces[before] + b) == [self.pieces[before], b]
            self.pairs[key] = known
        return known

    def _known(self, word: str) -> list[int]:
        """Ids of a text whose characters are all pieces, with no two space marks in a row."""
        n = len(word)
        last, start = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        known, follows = self.pairs.get, self.follows
        for end, (token, length) in self.automaton.iter(word):
            end += 1
            if last[end] == -2:
                before = last[end - length]
                if before != -2:
                    fits = known((before + 1) << 32 | token)
                    if fits or fits is None and follows(before, token):
                        last[end], start[end] = token, end - length
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def _run(self, n: int) -> list[int]:
        """Ids of ``n`` space marks that no word takes.

        Doubling pieces share one score, so merging goes left to right; long
        runs are whole copies of the longest piece and a rest.
        """
        if n not in self.runs:
            longest = max(len(p) for p in self.ids if set(p) == {SPACE})
            whole = max(0, n // longest - 2) if n > 4 * longest else 0
            found = [self.ids[p] for p in self.merged(SPACE * (n - whole * longest))]
            self.runs[n] = [self.ids[SPACE * longest]] * whole + found
        return self.runs[n]

    def unit(self, unit: str) -> list[int]:
        """Ids of a run of space marks with the word that follows it."""
        word = unit.lstrip(SPACE)
        marks = len(unit) - len(word)
        if not word:
            return self._run(marks)
        ids: list[int] = []
        rest = (SPACE if marks else "") + word
        if not set(rest) <= self.chars:
            start = 0
            for k, c in enumerate(rest):
                if c not in self.chars:
                    ids += self._known(rest[start:k]) if k > start else []
                    ids += [self.bytes[b] for b in c.encode()]
                    start = k + 1
            ids += self._known(rest[start:]) if start < len(rest) else []
        else:
            ids = self._known(rest)
        if marks > 1:
            alone = self.ids.get(SPACE)
            ids = self._run(marks) + ids[1:] if ids[0] == alone else self._run(marks - 1) + ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for u in self.units(SPACE + text.replace(" ", SPACE)):
            out += self.unit(u)
        return out

    def decoded(self, ids: list[int] | array) -> bytes:
        """The text of ids in UTF-8; bytes that are none become the sign for that."""
        data = b"".join(map(self.surface.__getitem__, ids))
        first = len(ids) > 0 and self.pieces[ids[0]].startswith(SPACE)
        return data[1 if first else 0 :].decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decoded(ids).decode()

    def _look(self, unit: str) -> tuple[bytes, bytes]:
        found = self.older.get(unit)
        if found is None:
            ids = self.unit(unit)
            found = b"".join([b"%d," % i for i in ids]), array(self.kind, ids).tobytes()
        if len(unit) <= LONGEST_REMEMBERED:
            if len(self.kept) >= REMEMBERED:
                self.older, self.kept = self.kept, {}
            self.kept[unit] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the decimal ids, sha256 of the text decoded from the ids."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        look = self._look
        found = [self.kept.get(u) or look(u) for u in self.units(SPACE + text.replace(" ", SPACE))]
        written = b"".join([f[0] for f in found])
        ids = array(self.kind)
        ids.frombytes(b"".join([f[1] for f in found]))
        return len(ids), hashlib.sha256(written[:-1]).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()


_TABLES: dict[int, PrefixTable] = {}


def _table(shared) -> PrefixTable:
    """One table a worker, kept between tasks."""
    if shared.id not in _TABLES:
        _TABLES.clear()
        _TABLES[shared.id] = PrefixTable(shared.vocabulary.value)
    return _TABLES[shared.id]


def few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


class _Shared:
    def __init__(self, spark, path: str):
        self.vocabulary = spark.sparkContext.broadcast(load_vocabulary(path))
        self.id = hash((path, self.vocabulary.id if hasattr(self.vocabulary, "id") else id(self.vocabulary)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the ids of every text."""
    shared = _Shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared)
        for part in few(batches):
            ids = [table.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the texts of ids as ``encode`` gives them."""
    shared = _Shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared)
        for part in few(batches):
            texts = [table.decode(i or []) for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, in one pass without a shuffle."""
    shared = _Shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared)
        for part in few(batches):
            found = [table.digest(t or "") for t in part.column(1).to_pylist()]
            n, a, b = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
