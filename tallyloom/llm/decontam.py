"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot
from .words import LETTERS, chained, slices, spans_hash

#: Words of a window, and of the grams it is fingerprinted by.
WINDOW, GRAM = 10, 5
#: Slots of the filter that goes to all tasks: some for each window of the benchmark, 32 MB at most.
PER_WINDOW, SLOTS = 64, 1 << 28
#: (window, item) rows up to which the windows are broadcast to confirm hits; some 100 bytes each.
BROADCAST_ROWS = 300_000


def _winnowed(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words its least gram hash: the fingerprint that winnowing keeps."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - gram + 1)
    grams = spans_hash(words, at, at + gram, 2)
    least = grams[: len(words) - window + 1].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, grams[k : k + len(least)], out=least)
    return least


class _Text:
    """The words of some rows, and hashes of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, (self.starts, self.ends, self.row) = data, LETTERS.words(data, offsets)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.hashes = LETTERS.hashes(data, self.starts, self.ends)
        self._second: np.ndarray | None = None

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on, as far as there are, are in one row."""
        return self.row[: max(0, len(self.row) - n + 1)] == self.row[n - 1 :]

    def digests(self, at: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for the n words from each place on."""
        if self._second is None:
            self._second = LETTERS.hashes(self.data, self.starts, self.ends, 1) if len(at) else self.hashes
        return chained(self.hashes, at, n, 3), chained(self._second, at, n, 4)


def _windows(window: int, gram: int):
    """Of each item the windows: their number of words, digest, and fingerprint for the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text")):
                text = _Text(data, offsets)
                sizes = np.diff(text.first)
                long = np.flatnonzero(text.whole(window))
                short = text.first[:-1][(sizes > 0) & (sizes < window)]
                at = np.concatenate([long, short])
                n = np.concatenate([np.full(len(long), window), sizes[(sizes > 0) & (sizes < window)]])
                hi, lo = text.digests(at, n)
                marks = np.concatenate([_winnowed(text.hashes, window, gram)[long], spans_hash(text.hashes, short, short + n[len(long) :], 3)])
                items = batch.column("item").slice(first, last - first).take(pa.array(text.row[at]))
                yield pa.RecordBatch.from_arrays([items, pa.array(n.astype(np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(marks.view(np.int64))], ["item", "n", "hi", "lo", "mark"])

    return run


def _filters(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slots // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (slots - 1)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    return run


def _hits(shared, slots: int, lengths: list[int], window: int, gram: int):
    """Of each document the words, and the places of windows that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(shared.value), np.uint8)

        def passed(hashes: np.ndarray, whole: np.ndarray) -> np.ndarray:
            at = (hashes & np.uint64(slots - 1)).astype(np.int64)
            return np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & whole)

        for batch in batches:
            for first, last, data, offsets in slices(batch.column("_text")):
                text = _Text(data, offsets)
                found = []
                for n in lengths:
                    if n < window:
                        places = np.arange(max(0, len(text.row) - n + 1))
                        at = passed(spans_hash(text.hashes, places, places + n, 3), text.whole(n))
                    else:
                        at = passed(_winnowed(text.hashes, window, gram), text.whole(n))
                    if len(at):
                        found.append((text.row[at], np.full(len(at), n), *text.digests(at, n), at - text.first[text.row[at]]))
                row, n, hi, lo, at = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if k in (2, 3) else np.int64) for k in range(5))
                order = np.lexsort((at, lo, hi, n, row))
                row, n, hi, lo, at = row[order], n[order], hi[order], lo[order], at[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (n[1:] != n[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
                heads = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), pa.array(at.astype(np.int32)))
                struct = pa.StructArray.from_arrays([pa.array(n[heads].astype(np.int32)), pa.array(hi[heads].view(np.int64)), pa.array(lo[heads].view(np.int64)), places], ["n", "hi", "lo", "at"])
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[heads], np.arange(last - first + 1)), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, last - first), pa.array(np.diff(text.first)), hits], ["_id", "n_words", "hits"])

    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words the confirmed windows of a document cover: the union of their runs."""
    for batch in batches:
        spans = batch.column("spans")
        flat = spans.flatten()
        at = flat.field("at")
        places = at.value_lengths().to_numpy()
        row = np.repeat(np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy()), places)
        starts = at.flatten().to_numpy().astype(np.int64)
        ends = starts + np.repeat(flat.field("n").to_numpy(), places)
        far = row * (int(ends.max(initial=0)) + 1)  # rows one behind another
        order = np.argsort(starts + far, kind="stable")
        starts, ends = (starts + far)[order], (ends + far)[order]
        before = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]]) if len(ends) else ends
        counts = np.bincount(row[order], np.maximum(0, ends - np.maximum(starts, before)), len(spans)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array(counts), batch.column("lists")], ["_rid", "n_hit", "lists"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """What every row of `docs` shares with the items of `benchmark`.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is
    `window` consecutive words of an item; an item of fewer words, but not none, is one window. All
    document words inside any occurrence of a window are hit. Null texts have no words; items with
    null text or null id have no windows. Repeated rows and ids each keep their row; items with one
    id count once. Empty tables give no rows or no hits; other columns are ignored. Returns (id,
    n_words, n_hit, n_items, items_sha256 of the sorted, comma-joined ids, contaminated).

    Of each window winnowing keeps the least gram hash, so every shared span of `window` words
    shares a kept fingerprint. The benchmark's fingerprints go to all tasks as a filter, sized by
    the number of windows up to SLOTS bits (beyond, more windows pass and are refuted by the join);
    windows whose fingerprint passes are extended to 128-bit digests of all their words and
    joined with the benchmark's windows, which confirms them. The windows are broadcast if they
    are few and shuffled otherwise. Texts are read once and never leave their task. A document
    carries digests of the item lists of its windows, not the items: lists that occur together are
    united once, however many documents share them."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("item is not null")
    windows = cut(items.mapInArrow(_windows(window, gram), "item string, n int, hi long, lo long, mark long").distinct())
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    count = windows.count()
    slots = min(SLOTS, max(1 << 16, 1 << (PER_WINDOW * count).bit_length()))
    bits = np.zeros(slots // 8, np.uint8)
    for part in windows.select("mark").distinct().coalesce(8).mapInArrow(_filters(slots), "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(bytes(part["bits"])), np.uint8)
    shared = spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    schema = f"_id {kind}, n_words long, hits array<struct<n: int, hi: bigint, lo: bigint, at: array<int>>>"
    rows = cut(texts.mapInArrow(_hits(shared, slots, lengths, window, gram), schema).withColumn("_rid", F.monotonically_increasing_id()))
    listed = cut(windows.groupBy("n", "hi", "lo").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("list", F.sha2(F.to_json("items"), 256)))
    known = listed.select("n", "hi", "lo", "list")
    if count <= broadcast_rows:
        known = F.broadcast(known)
    hits = rows.select("_rid", F.explode("hits").alias("h")).select("_rid", "h.*").join(known, ["n", "hi", "lo"])
    by_row = hits.groupBy("_rid").agg(F.collect_list(F.struct("n", "at")).alias("spans"), F.array_sort(F.collect_set("list")).alias("lists"))
    counted = cut(by_row.mapInArrow(_covered, "_rid long, n_hit long, lists array<string>").withColumn("_sets", F.sha2(F.array_join("lists", ","), 256)))
    sets = counted.groupBy("_sets").agg(F.count("*").alias("_n"), F.first("lists").alias("lists"))
    members = sets.select("_sets", "_n", F.explode("lists").alias("list")).join(listed.select("list", "items").dropDuplicates(["list"]), "list").select("_sets", "_n", F.explode("items").alias("item")).distinct()
    united = members.groupBy("_sets").agg(F.first("_n").alias("_n"), F.array_sort(F.collect_list("item")).alias("items"))
    named = cut(united.select("_sets", "_n", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    found = join_hot(counted.select("_rid", "n_hit", "_sets"), named, "_sets", "_n").drop("_sets")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("_id", "_rid", "n_words").join(found, "_rid", "left").select(
        F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
