"""Token ids in files of patched frame-of-reference blocks.

A block holds 128 ids.  Its minimum is subtracted; a width that nine tenths of
the differences fit in is chosen; all differences are packed at that width, and
the high bits of the few that are wider stand in an exception list at the end of
the block.  An index gives the byte at which each block starts, so a reader can
fetch any range of ids alone.

File (all numbers little-endian, except packed bits, which run from the high bit):

    "PFR1", u32 block size, u64 documents, u64 ids, u64 blocks, u64 payload bytes
    documents: i64 doc_id, u8 1 where the id is null, u64 number of ids
    blocks: u64 first byte (from the payload's start), u32 minimum, u8 width, u8 exceptions
    payload, per block: 128 differences of ``width`` bits, u8 positions, u32 high bits

Documents are in ascending doc_id order (null ids first, equal ids by text), and
files follow one another by (part, seq) in the same order.  A null text counts as
empty and gives the end id alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, range_partition, running_before, tie_of
from .words import LOWER, KeyTable, distinct, joined, lanes, with_nul

BLOCK = 128
#: Index of the difference, of 128 in order, that must fit in the width.
FIT = 115
HEAD = struct.Struct("<4sIQQQQ")
STEP = 4096  # blocks handled at once, for bounded memory
MOST_TASKS = 200_000


def _bits(x: np.ndarray, w: int) -> np.ndarray:
    """A row of the low ``w`` bits for each number."""
    wide = 16 if w <= 16 else 32
    return np.unpackbits(x.astype(f">u{wide // 8}").view(np.uint8).reshape(-1, wide // 8), axis=1)[:, wide - w :]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(starts, minima, widths, exception counts, payload) of uint32 ids."""
    n = -(-len(ids) // BLOCK)
    if n == 0:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4"), np.zeros(0, "u1"), np.zeros(0, "u1"), b""
    starts, minima, widths, counts, payload, at = [], [], [], [], [], 0
    for b in range(0, n, STEP):
        part = ids[b * BLOCK : (b + STEP) * BLOCK]
        if len(part) % BLOCK:
            part = np.concatenate([part, np.full(-len(part) % BLOCK, part[-1], part.dtype)])
        x = part.reshape(-1, BLOCK).astype(np.uint32)
        low = x.min(axis=1)
        x = x - low[:, None]
        width = np.frexp(np.partition(x, FIT, axis=1)[:, FIT].astype(np.float64))[1].astype(np.uint8)
        high = (x.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
        row, pos = np.nonzero(high)
        count = np.bincount(row, minlength=len(x)).astype(np.uint8)
        size = width.astype(np.int64) * (BLOCK // 8) + 5 * count.astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        out = np.zeros(int(size.sum()), np.uint8)
        for w in np.unique(width):
            if w:
                own = np.nonzero(width == w)[0]
                bits = _bits(x[own], int(w))
                packed = np.packbits(bits.reshape(len(own), -1), axis=1)
                out[start[own][:, None] + np.arange(packed.shape[1])] = packed
        if len(row):
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            first = start[row] + width[row].astype(np.int64) * (BLOCK // 8)
            out[first + nth] = pos
            values = high[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
            out[(first + count[row] + 4 * nth)[:, None] + np.arange(4)] = values
        starts.append(start + at)
        minima.append(low)
        widths.append(width)
        counts.append(count)
        payload.append(out.tobytes())
        at += len(out)
    return np.concatenate(starts).astype("<u8"), np.concatenate(minima).astype("<u4"), np.concatenate(widths), np.concatenate(counts), b"".join(payload)


def unpack(starts: np.ndarray, minima: np.ndarray, widths: np.ndarray, counts: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, uint32; ``starts`` count from the first byte of ``payload``."""
    out = np.empty((len(starts), BLOCK), np.uint32)
    starts = starts.astype(np.int64)
    for b in range(0, len(starts), STEP):
        start, width, count = starts[b : b + STEP], widths[b : b + STEP], counts[b : b + STEP]
        x = np.zeros((len(start), BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                own = np.nonzero(width == w)[0]
                packed = payload[start[own][:, None] + np.arange(int(w) * (BLOCK // 8))]
                wide = 16 if w <= 16 else 32
                bits = np.zeros((len(own) * BLOCK, wide), np.uint8)
                bits[:, wide - int(w) :] = np.unpackbits(packed, axis=1).reshape(-1, int(w))
                x[own] = np.packbits(bits, axis=1).view(f">u{wide // 8}").reshape(len(own), BLOCK)
        if total := int(count.sum()):
            row = np.repeat(np.arange(len(start)), count)
            nth = np.arange(total) - np.searchsorted(row, row)
            first = start[row] + width[row].astype(np.int64) * (BLOCK // 8)
            values = payload[(first + count[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
            x[row, payload[first + nth]] |= (values.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
        out[b : b + STEP] = x + minima[b : b + STEP].astype(np.uint32)[:, None]
    return out.reshape(-1)


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One whole file."""
    starts, minima, widths, counts, payload = pack(ids)
    head = HEAD.pack(b"PFR1", BLOCK, len(doc_ids), len(ids), len(starts), len(payload))
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, known.tobytes(), null.tobytes(), lengths.astype("<u8").tobytes(), starts.tobytes(), minima.tobytes(), widths.tobytes(), counts.tobytes(), payload])


class PackedFile:
    """A file opened for reading: documents and index in memory, ids on demand."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        magic, block, docs, self.n_ids, self.n_blocks, self.n_payload = HEAD.unpack(self.file.read(HEAD.size))
        if magic != b"PFR1" or block != BLOCK:
            raise ValueError(f"not a file of packed ids: {uri}")
        known, null = np.frombuffer(self.file.read(8 * docs), "<i8"), np.frombuffer(self.file.read(docs), "u1")
        self.doc_ids = [None if gone else int(d) for d, gone in zip(known, null, strict=True)]
        self.lengths = np.frombuffer(self.file.read(8 * docs), "<u8").astype(np.int64)
        self.starts = np.frombuffer(self.file.read(8 * self.n_blocks), "<u8")
        self.minima = np.frombuffer(self.file.read(4 * self.n_blocks), "<u4")
        self.widths = np.frombuffer(self.file.read(self.n_blocks), "u1")
        self.counts = np.frombuffer(self.file.read(self.n_blocks), "u1")
        self.payload_at = self.file.tell()

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first..last-1, reading only their blocks."""
        last = min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        start = int(self.starts[a])
        end = int(self.starts[b]) if b < self.n_blocks else self.n_payload
        self.file.seek(self.payload_at + start)
        data = np.frombuffer(self.file.read(end - start), np.uint8)
        x = unpack(self.starts[a:b] - self.starts[a], self.minima[a:b], self.widths[a:b], self.counts[a:b], data)
        return x[first - a * BLOCK : last - a * BLOCK]

    def close(self) -> None:
        self.file.close()


class UnitTable(KeyTable):
    """Ids of short units, compared whole, so a clash of hashes never gives wrong ids."""

    MOST = 1 << 20

    def __init__(self, kind: np.dtype):
        self.kind = kind
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.first, self.count = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.pool, self.used = np.zeros(1 << 20, self.kind), 0

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct units that are not known, with their ids one after another."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        slot = self.put(low, high)
        self.first[slot], self.count[slot] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 letter, 2 digit, 3 other printable, 4 what sends its word to the library whole."""
    out = np.full(256, 4, np.uint8)
    out[0x21:0x7F] = 3
    out[list(b" \t\n\r\x0b\x0c")] = 0
    out[0x30:0x3A] = 2
    out[0x61:0x7B] = 1
    out[0x27] = 4  # an apostrophe may begin a piece of its own kind
    return out


_CLASS = _classes()


class WordIds:
    """Ids of texts by the tokenizers library, each distinct unit encoded once while it is remembered.

    Valid for tokenizers that drop white space, never join characters across it
    and mark word ends, as ``check`` makes sure.  Texts are cut by byte classes
    into the tokenizer's own pieces (runs of ASCII and Latin-1 letters, digits,
    runs of other signs); a word with anything else is one unit.  Units of up to 16
    bytes are looked up in one go; the library gets the others, and new ones,
    many at once.
    """

    TOGETHER = 400
    LONG = 200_000
    #: Bytes cut into units at once.
    STRETCH = 1 << 20

    def __init__(self, source: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.spec = json.loads(source)
        mark = self.spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(mark) and token.endswith(mark)
        self.table = UnitTable(self.kind)
        self.long: dict[bytes, np.ndarray] = {}

    def check(self) -> None:
        t = self.tokenizer
        split = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" or not self.ends.any():
            raise ValueError("this tokenizer splits words in another way")
        for a, b in (("ab", "cd"), ("1", "2"), ("x.", "'s"), ("é", "́")):
            for gap in " \t\n\r\x0b\x0c":
                both = t.encode(a + gap + gap + b, add_special_tokens=False).ids
                if both != t.encode(a, add_special_tokens=False).ids + t.encode(b, add_special_tokens=False).ids:
                    raise ValueError("this tokenizer does not treat words one by one")

    def _alone(self, units: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]

    def _learn(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        """Encode distinct units, given as words and lengths, and remember them."""
        both = np.stack([low, high], axis=1).view(np.uint8)  # 16 bytes each, the rest 0
        both[np.arange(len(size))[size < 16], size[size < 16]] = 32
        keep = np.arange(16)[None, :] <= size[:, None]
        long_ = size == 16
        ids, counts = [], np.zeros(len(size), np.int32)
        for a in range(0, len(size), 64 * self.TOGETHER):
            cuts = list(range(a, min(a + 64 * self.TOGETHER, len(size)), self.TOGETHER))
            groups = []
            for b in cuts:
                part = slice(b, b + self.TOGETHER)
                if long_[part].any():
                    groups.append(b" ".join(x[:n].tobytes() for x, n in zip(both[part], size[part], strict=True)))
                else:
                    groups.append(both[part][keep[part]].tobytes())
            for b, e in zip(cuts, self.tokenizer.encode_batch_fast([g.decode() for g in groups], add_special_tokens=False), strict=True):
                own = np.array(e.ids, self.kind)
                last = np.nonzero(self.ends[own])[0] + 1
                part = slice(b, min(b + self.TOGETHER, len(size)))
                # as many word ends as units, and no special token, which has none
                if len(last) == part.stop - b and b"<|" not in groups[(b - a) // self.TOGETHER]:
                    counts[part] = np.diff(last, prepend=0)
                else:
                    each = self._alone([x[:n].tobytes() for x, n in zip(both[part], size[part], strict=True)])
                    counts[part] = [len(x) for x in each]
                    own = np.concatenate(each)
                ids.append(own)
        self.table.add(low, high, np.concatenate(ids), counts)

    def _ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, number of ids) of each unit, and all ids; ``data`` ends with 16 spaces."""
        raw = np.frombuffer(data, np.uint8)
        text = LOWER[raw]
        kind = _CLASS[text]
        # Latin-1 letters: C3 and a byte that stands for no sign
        lead = np.nonzero(text[:-1] == 0xC3)[0]
        after = text[lead + 1]
        lead = lead[(after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        capital = lead[text[lead + 1] < 0x9F]
        text[capital + 1] += 32
        inside = kind != 0
        edge = np.empty(len(kind), bool)
        edge[0] = inside[0]
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # words with anything else are one unit, in the case they are written in
        odd = np.nonzero((kind == 4) | ((raw == 0x3C) & (np.roll(raw, -1) == 0x7C)))[0]
        if len(odd):
            step = np.diff(inside.view(np.int8), prepend=np.int8(0))
            begin, end = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
            words = np.unique(np.searchsorted(begin, odd, side="right") - 1)
            size = end[words] - begin[words]
            own = np.repeat(begin[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            text[own] = raw[own]
            edge[own] = False
            edge[begin[words]] = True
        at = np.nonzero(edge)[0]
        starts = inside[at]
        size = np.diff(at, append=len(kind))[starts]
        at = at[starts]
        if not len(at):
            return at, np.zeros(0, np.int64), np.zeros(0, self.kind)
        low, high = lanes(text, at, size)
        short = (size <= 16) & ~with_nul(text, at, size)
        if self.table.keys > self.table.MOST:
            self.table.clear()
        slot = np.full(len(at), -1, np.int64)
        slot[short] = self.table.find(low[short], high[short])
        new = np.nonzero(short & (slot < 0))[0]
        if len(new):
            some = new[distinct(low[new], high[new])]
            self._learn(low[some], high[some], size[some])
            slot[new] = self.table.find(low[new], high[new])
        count, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[short], start[short] = self.table.count[slot[short]], self.table.first[slot[short]]
        far = np.nonzero(~short)[0].tolist()
        pool = self.table.pool
        if far:  # long units: whole words in their own case, or pieces
            units = [text[at[i] : at[i] + size[i]].tobytes() for i in far]
            if len(self.long) > self.LONG:
                self.long.clear()
            unknown = list(set(units).difference(self.long))
            self.long.update(zip(unknown, self._alone(unknown), strict=True))
            found = [self.long[u] for u in units]
            count[far] = [len(x) for x in found]
            start[far] = self.table.used + np.cumsum(count[far]) - count[far]
            pool = np.concatenate([pool[: self.table.used], *found])
        where = np.repeat(start - (np.cumsum(count) - count), count)
        where += np.arange(len(where))
        return at, count, pool[where]

    def _stretch(self, texts: list[bytes]) -> list[bytes]:
        data, first = joined(texts)
        at, count, ids = self._ids(data)
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(at, first)] * self.kind.itemsize
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        held, size = [], 0
        for t in texts:
            if size + len(t) > self.STRETCH and held:
                out += self._stretch(held)
                held, size = [], 0
            if len(t) > self.STRETCH:  # a long text goes by stretches that end at a white space
                out.append(b"".join(self._stretch([part])[0] for part in self._parts(t)))
            else:
                held.append(t)
                size += len(t)
        return out + (self._stretch(held) if held else [])

    def _parts(self, text: bytes) -> Iterator[bytes]:
        import re

        space, a = re.compile(rb"[ \t\n\r\x0b\x0c]"), 0
        while a < len(text):
            found = space.search(text, min(a + self.STRETCH, len(text)))
            b = found.end() if found else len(text)
            yield text[a:b]
            a = b


_ENCODERS: dict[int, WordIds] = {}


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, docs_per_file: int = 8192, ids_per_file: int = 1 << 24) -> DataFrame:
    """Encode the documents and write them as files under ``folder``; returns the plan of (part, seq, path, n_docs, n_ids, n_bytes).

    A file's name follows from its part and sequence alone and it is moved into
    place whole, so tasks that run again leave the same files.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    WordIds(source).check()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(source)
    key = hash(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        gc.disable()  # many small objects and no cycles
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyarrow import fs

        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = WordIds(shared.value)
        words = _ENCODERS[key]
        end = np.array([end_id], words.kind).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, seq, doc_ids, pieces, held = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) // words.kind.itemsize for p in pieces], np.int64)
            data = to_bytes(doc_ids, lengths, np.frombuffer(b"".join(pieces), words.kind))
            name = f"part-{part:08d}-{seq:06d}.pfr"
            mine = f"{root}/.{name}.{os.getpid()}-{os.urandom(6).hex()}"
            with store.open_output_stream(mine) as out:
                out.write(data)
            store.move(mine, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int32()), (seq, pa.int32()), (f"{folder}/{name}", pa.string()), (len(doc_ids), pa.int64()), (int(lengths.sum()), pa.int64()), (len(data), pa.int64()))], ["part", "seq", "path", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            parts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            encoded = words.encode([t or b"" for t in batch.column(2).to_pylist()])
            for p, d, e in zip(parts, own, encoded, strict=True):
                if doc_ids and (p != part or held >= ids_per_file):
                    yield flush()
                    seq, doc_ids, pieces, held = (seq + 1 if p == part else 0), [], [], 0
                part = p
                doc_ids.append(d)
                pieces.append(e + end)
                held += len(e) // words.kind.itemsize + 1
        if doc_ids:
            yield flush()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered, parts = range_partition(rows, "doc_id", docs_per_file, tie_of(F.col("text")))
    tasks = min(parts, MOST_TASKS)  # neighbouring parts share a task where there are very many
    ordered = ordered.select("__part", "doc_id", "text").repartitionById(tasks, F.floor(F.col("__part").cast("long") * tasks / parts).cast("int"))
    ordered = ordered.sortWithinPartitions("__part", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long, n_bytes long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files of a written manifest; start counts the ids of all documents before."""
    placed = running_before(manifest.withColumn("__bucket", F.floor(F.col("part") / 256)), [], "__bucket", [F.col("part"), F.col("seq")], "n_ids", "before")
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = PackedFile(path)
                ends = np.cumsum(file.lengths)
                crcs, held, first = [], np.zeros(0, "<u4"), 0
                for n, end in zip(file.lengths, ends, strict=True):
                    if end > first + len(held):  # the next stretch of whole blocks, at least this document
                        held = np.concatenate([held[end - n - first :], file.ids(first + len(held), max(int(end), first + len(held) + (1 << 20)))]).astype("<u4")
                        first = int(end - n)
                    crcs.append(zlib.crc32(held[end - n - first : end - first].tobytes()))
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(before + ends - file.lengths, pa.int64()), pa.array(file.lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.select("path", "before", "part").repartitionById(min(files, 100_000), F.pmod(F.col("part"), F.lit(min(files, 100_000)))).select("path", "before")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back."""
    scratch = Scratch(spark, "packed-ids")
    manifest = scratch.table(write(docs, tokenizer_path, end_id, scratch.path("files")), "manifest")
    return read(manifest)
