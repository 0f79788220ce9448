"""Token ids in patched frame-of-reference files."""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import cut, partitions

MAGIC, SUFFIX = b"PFOR0001", ".pfor"
#: Ids in a block, the share of them that the packed width must hold, and ids in a file, about.
BLOCK, SHARE, FILE_IDS = 128, 0.9, 1 << 21
#: Words whose ids a worker remembers, and their bytes; beyond either it begins anew.
REMEMBERED, REMEMBERED_BYTES = 2_000_000, 32 << 20
_HEAD = struct.Struct("<8sqqqqq")


def pack(ids: np.ndarray) -> bytes:
    """Blocks of BLOCK ids: the least is subtracted, the rest packed at the width that holds SHARE of
    them; larger ones are exceptions with their place and value. Mins, widths, exception counts
    and block starts come first, so any block can be read alone; the last block is padded."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    held = int(np.ceil(SHARE * BLOCK)) - 1
    top = np.partition(rest, held, axis=1)[:, held] if blocks else np.zeros(0, np.uint32)
    width = np.frexp(top.astype(np.float64))[1].astype(np.uint8)
    outlier = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    places, values = np.nonzero(outlier)[1].astype(np.uint8), rest[outlier].astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(int(starts[-1]), np.uint8)
    rest[outlier] = 0
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        columns = np.ascontiguousarray(rest[at].T).astype(np.uint64)
        words = np.zeros((2 * w, len(at)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            words[word] |= columns[j] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= columns[j] >> np.uint64(64 - shift)
        packed[starts[at][:, None] + np.arange(16 * w)] = np.ascontiguousarray(words.T).view(np.uint8).reshape(len(at), 16 * w)
    count = outlier.sum(axis=1).astype(np.uint8)
    return b"".join([struct.pack("<qqq", len(ids), blocks, len(values)), least.astype("<u4").tobytes(), width.tobytes(), count.tobytes(), starts.astype("<i8").tobytes(), packed.tobytes(), places.tobytes(), values.astype("<u4").tobytes()])


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last - 1, of all without `last`."""
    total, blocks, outliers = struct.unpack_from("<qqq", data)
    last, at = blocks if last is None else min(last, blocks), 24

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    least, width, count, starts = part("<u4", blocks), part("u1", blocks), part("u1", blocks), part("<i8", blocks + 1)
    packed, places, values = part("u1", int(starts[-1])), part("u1", outliers), part("<u4", outliers)
    before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    rest = np.zeros((last - first, BLOCK), np.uint32)
    width = width[first:last]
    for w in np.unique(width[width > 0]).tolist():
        at_w = np.flatnonzero(width == w)
        words = np.ascontiguousarray(packed[starts[first:last][at_w][:, None] + np.arange(16 * w)]).view("<u8").T
        columns, mask = np.zeros((BLOCK, len(at_w)), np.uint32), np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            value = words[word] >> np.uint64(shift)
            if shift + w > 64:
                value = value | (words[word + 1] << np.uint64(64 - shift))
            columns[j] = value & mask
        rest[at_w] = columns.T
    own = slice(int(before[first]), int(before[last]))
    rest[np.repeat(np.arange(last - first), count[first:last]), places[own]] = values[own]
    return (rest + least[first:last, None]).ravel()[: max(0, total - first * BLOCK)]


#: ASCII marks that end a word, and the bytes behind which such marks are tokens of their own.
_MARKS, _ENDINGS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class _Known(dict):
    """Numbers of pieces in the order they first come; `new` are those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.bytes = 0

    def __missing__(self, piece: bytes) -> int:
        number = len(self)
        self[piece] = number
        self.new.append(piece)
        self.bytes += len(piece)
        return number


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library that drops white space.

    Such a tokenizer encodes what stands between ASCII white space on its own, and most of that
    recurs, so the ids of pieces are remembered; all ids come from the library. ASCII letters are
    lower-cased first, as the tokenizer does later, unless a text has combining marks, whose
    composition may depend on case. Marks behind a word's last letter or digit begin a token, so a
    word with marks has the ids of both. Texts with something like a special token are encoded whole."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.starts, self.flat, self.used, self.held = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32), 0, 0
        self.known[b""] = 0  # no piece is empty
        self._remember([[self.end]])

    def _remember(self, ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, m = self.used + len(ids), self.held + int(lengths.sum())
        if n + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (n + 1))
        if m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * m)
        self.flat[self.held : m] = np.fromiter(chain.from_iterable(ids), np.uint32, m - self.held)
        self.starts[self.used] = self.held
        self.starts[self.used + 1 : n + 1] = self.held + np.cumsum(lengths)
        self.used, self.held = n, m

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self) -> None:
        """Remember the ids of new pieces; those of words with marks come from both parts."""
        new, both, plain, first = self.known.new, {}, [], self.used
        at = 0
        while at < len(new):
            piece = new[at]
            word = piece.rstrip(_MARKS)
            if len(word) < len(piece) and word and word[-1] in _ENDINGS and b"<|" not in piece:
                both[at] = self.known[word], self.known[piece[len(word) :]]  # these may be new as well
            else:
                plain.append(at)
            at += 1
        ids: list = [None] * len(new)
        for k, found in zip(plain, self._encoded([new[k] for k in plain]), strict=True):
            ids[k] = found
        for k, parts in both.items():
            ids[k] = [i for n in parts for i in (ids[n - first] if n >= first else self.flat[self.starts[n] : self.starts[n + 1]].tolist())]
        self._remember(ids)
        self.known.new = []

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, with an end id after each text; number of ids of each text)."""
        if self.used > REMEMBERED or self.known.bytes > REMEMBERED_BYTES:
            self._forget()
        pieces, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            text = text or b""
            if b"<|" in text:
                found = [text]
            else:
                found = (text if b"\xcc" in text or b"\xcd" in text else text.lower()).split()
            pieces += found
            pieces.append(b"")
            counts[i] = len(found) + 1
        collecting = gc.isenabled()
        gc.disable()  # a great many small objects, none of them in a cycle
        try:
            at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            if self.known.new:
                self._learn()
        finally:
            if collecting:
                gc.enable()
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        texts_end = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(texts_end)


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    """This worker's encoder, which later tasks find again."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def _head(part: int, file: int, before: int, docs: int, ids: int) -> bytes:
    return _HEAD.pack(MAGIC, part, file, before, docs, ids)


def _written(folder: str, path: str, end: int, file_ids: int):
    """Encode sorted documents and write files; a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = _encoder(path, end)
        names, ids, counts, rows = [], [], [], []
        done = 0

        def flush() -> None:
            nonlocal done
            if not names:
                return
            flat, sizes = np.concatenate(ids), np.concatenate(counts)
            name = f"part-{part:06d}-{len(rows):06d}{SUFFIX}"
            known = np.array([n is not None for n in names], np.uint8)
            body = [_head(part, len(rows), done, len(names), len(flat)), np.array([n or 0 for n in names], "<i8").tobytes(), known.tobytes(), sizes.astype("<i8").tobytes(), pack(flat)]
            rows.append((part, name, len(names), len(flat), files.put(folder, name, iter(body))))
            done += len(flat)
            names.clear(), ids.clear(), counts.clear()

        for batch in batches:
            texts, own = batch.column("_text"), batch.column("_id").to_pylist()
            sizes = texts.cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
            first = 0
            while first < len(own):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 20), "right")) - 1)
                some, n = encoder.encode(texts.slice(first, last - first).to_pylist())
                names += own[first:last]
                ids.append(some)
                counts.append(n)
                if sum(map(len, ids)) >= file_ids:
                    flush()
                first = last
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "file", "docs", "ids", "bytes"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write their ids in ascending id order; (part, file, docs, ids, bytes).

    Rows are dealt into ranges of ids and of how their texts begin, sorted by Spark, and encoded in order; each range writes
    files of about `file_ids` ids that hold whole documents, their ids and lengths, and how many
    ids of the range come before. Each document ends with `end`; a null text is empty, null ids
    come first, rows with one id are ordered by text. A repeated attempt writes the same files."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    begins = F.substring("_text", 1, 64)  # an id that very many rows have goes to several ranges
    ordered = texts.repartitionByRange(partitions(docs.sparkSession), F.col("_id"), begins).sortWithinPartitions("_id", "_text")
    return cut(ordered.mapInArrow(_written(folder, tokenizer, end, file_ids), "part long, file string, docs long, ids long, bytes long"))


def parse(content: bytes) -> tuple[int, int, list[int | None], np.ndarray, bytes]:
    """(range, ids of the range before this file, document ids, lengths, packed ids) of a file."""
    magic, part, _, before, docs, _ = _HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a file of packed token ids")
    at = _HEAD.size
    names = np.frombuffer(content, "<i8", docs, at).tolist()
    known = np.frombuffer(content, "u1", docs, at + 8 * docs).tolist()
    lengths = np.frombuffer(content, "<i8", docs, at + 9 * docs)
    return part, before, [n if k else None for n, k in zip(names, known, strict=True)], lengths, content[at + 17 * docs :]


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files, of each document (id, start, n_tokens, ids_crc32): the ids of all documents
    before it, its own, and the CRC of its ids as little-endian 32-bit integers.

    The totals of the ranges, one number for each, go to all tasks; the rest is in the files."""
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    starts, before = {}, 0
    for part in sorted(totals):
        starts[part], before = before, before + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                part, at, names, lengths, packed = parse(content.as_py())
                ids = unpack(packed).astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids)
                crcs = [zlib.crc32(view[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts[part] + at + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return files.read(spark, folder, SUFFIX).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files, read them back, and return what `read_tokens` returns for all rows of
    `docs`; the files are removed. An empty table gives no rows; other columns are ignored, whatever their names.
    Rows with one id each keep their row, in order of their texts; equal rows differ in `start` alone. A very
    long text is encoded whole, and lies in one file with those beside it."""
    spark = docs.sparkSession
    folder = files.shared_folder(spark, "tokens")
    try:
        manifest = write_tokens(docs, folder, tokenizer, end, id_col=id_col, text_col=text_col)
        if not manifest.take(1):
            return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
        return cut(read_tokens(spark, folder, manifest, id_col))
    finally:
        files.remove(spark, folder)
