"""Removal of long substrings that earlier documents hold, by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import cut, partitions
from .words import bytes_hash, distinct, eights, mixed, slices

#: Bytes of a repeated string, and of the grams whose least hash stands for it.
LENGTH, GRAM = 50, 24
#: Bytes of text, and rows, of a group of documents.
GROUP_BYTES, GROUP_ROWS = 8 << 20, 1 << 16
#: Parts that grams are dealt to, and buckets of groups, for each of Spark's shuffle partitions; parts at most.
PARTS, MOST_PARTS = 2, 1 << 16
#: Positions whose buckets are refined together, about, and bytes whose grams are hashed together.
POSITIONS, PIECE = 1 << 20, 1 << 18
LAST = np.iinfo(np.int64).max
#: Groups from this number on hold rows without id, which are all equally late.
NULLS = 1 << 50
#: What the groups are told about a context: an earlier group has it; earlier groups have its gram in
#: other contexts; later groups need its bytes.
ALL, PARTLY, NEEDED = 1, 2, 3
#: Bits by which a gram is known.
GRAM_BITS = np.uint64(48)
_FACTORS = np.random.default_rng(41).integers(1 << 62, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 32) - 1)


def _steps(gram: int) -> list[int]:
    """Where the eights begin that cover a gram."""
    return [*range(0, gram - 8, 8), gram - 8]


def _least_at(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """For each run of `window` grams the place of the least by 32 bits of its hash, the first of equals."""
    eight, n = np.ascontiguousarray(eights(data)[:-8]), len(data) - gram + 1
    value = np.zeros(n, np.uint64)
    for k, step in enumerate(_steps(gram)):
        value += eight[step : step + n] * _FACTORS[k]
    value &= ~_LOW
    value |= np.arange(n, dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        value = np.minimum(value[step:], value[:-step])
        width += step
    return (value & _LOW).astype(np.int64)


def _runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> list[bytes]:
    """For each document the runs of strings that one gram stands for, two bytes each: how many
    strings, and how far behind the first one's start the gram lies."""
    if len(data) < length:
        return [b""] * (len(offsets) - 1)
    if len(offsets) == 2 and len(data) > 4 * PIECE:  # a long document in pieces, whose last runs may go on
        pieces = [data[k : k + PIECE + length - 1] for k in range(0, len(data) - length + 1, PIECE)]
        return [b"".join(r for piece in pieces for r in _runs_of(piece, np.array([0, len(piece)]), length, gram))]
    least = _least_at(data, gram, length - gram + 1)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        least[max(a, b - length + 1) : b] = -1  # strings that would run into the next document
    heads = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    counts = np.diff(np.append(heads, len(least)))
    real = least[heads] >= 0
    heads, counts = heads[real], counts[real]
    pairs = np.stack([counts, least[heads] - heads], axis=1).astype(np.uint8)
    bounds = np.searchsorted(heads, offsets).tolist()
    return [pairs[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


GROUPED = {"g": pa.int64(), "r": pa.int32(), "_id": pa.int64(), "_text": pa.binary(), "_runs": pa.binary()}


def _grouped(length: int, gram: int, group_bytes: int, group_rows: int):
    """Rows in order of their ids, with numbers of groups and of rows in them: a group ends when it is
    large and the id changes, and rows without id have groups of their own. Grams are looked for
    here once; all later steps find them by the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, rows, before = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            ids, texts = batch.column("_id").to_pylist(), batch.column("_text")
            bytes_of = pc.binary_length(texts).to_pylist()
            groups, places = [], []
            for own, n in zip(ids, bytes_of, strict=True):
                if rows and ((own is None) != (before is None) or (size >= group_bytes or rows >= group_rows) and (own is None or own != before)):
                    number, size, rows = number + 1, 0, 0
                groups.append((NULLS if own is None else 0) + (part << 24) + number)
                places.append(rows)
                size, rows, before = size + n, rows + 1, own
            runs = [r for _, _, data, offsets in slices(texts, PIECE) for r in _runs_of(data, offsets, length, gram)]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(places, pa.int32()), batch.column("_id"), texts, pa.array(runs, pa.binary())], list(GROUPED))

    return run


class Group:
    """Some documents, the grams that stand for their strings, and the contexts of these.

    Each string of `length` bytes is assigned to the least of its gram hashes, so equal strings
    are assigned to equal grams. An occurrence is a gram with a run of strings; its context are the
    bytes that the strings cover. A gram is known by 48 bits of a hash, the first of which name its
    part; a context by its gram and 64 bits of a digest of its bytes."""

    def __init__(self, docs: pa.Table, length: int, gram: int, parts: int):
        docs = docs.sort_by("r").combine_chunks()
        self.group, self.length, self.parts = docs.column("g")[0].as_py(), length, parts
        ids = docs.column("_id").combine_chunks()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        (_, _, self.data, self.bounds), *_ = slices(docs.column("_text"), 1 << 62)
        (_, _, runs, run_bounds), *_ = slices(docs.column("_runs"), 1 << 62)
        runs, per_row = runs.reshape(-1, 2).astype(np.int64), np.diff(run_bounds) // 2
        self.eight = eights(self.data)
        self.row, self.count = np.repeat(np.arange(len(self.ids)), per_row), runs[:, 0]
        before = np.cumsum(self.count) - self.count
        firsts = np.concatenate([before, [0]])[np.minimum(run_bounds[:-1] // 2, len(before))]
        self.start = before - firsts[self.row] + self.bounds[self.row]
        at, h = self.start + runs[:, 1], np.zeros(len(runs), np.uint64)
        for step in _steps(gram):
            h = mixed(h ^ self.eight[at + step])
        self.gram = h >> (np.uint64(64) - GRAM_BITS)

    def grams(self) -> np.ndarray:
        return distinct(self.gram)

    def keep(self, some: np.ndarray) -> None:
        self.gram, self.row, self.start, self.count = (x[some] for x in (self.gram, self.row, self.start, self.count))

    def keep_grams(self, grams: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(grams, self.gram), max(0, len(grams) - 1))
        self.keep(grams[at] == self.gram if len(grams) else np.zeros(len(self.gram), bool))

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context of each occurrence, an occurrence of each context, the least id that has it, its
        digest), the contexts in an order that depends on them alone."""
        ids, around = self.ids[self.row], bytes_hash(self.eight, self.start, self.count + self.length - 1, 5)
        order = np.lexsort((ids, around, self.gram))
        gram, sorted_around = self.gram[order], around[order]
        new = np.ones(len(order), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (sorted_around[1:] != sorted_around[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return which, order[new], ids[order][new], sorted_around[new]

    def by_part(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        return _by_part(grams, self.parts)


def _by_part(grams: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, first, last) of the parts of sorted grams."""
    if not len(grams):
        return []
    names, heads = np.unique(grams * np.uint64(parts) >> GRAM_BITS, return_index=True)
    return list(zip(names.astype(int).tolist(), heads.tolist(), [*heads[1:].tolist(), len(grams)], strict=True))


def _packed(grams: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted grams as their lower 32 and upper 16 bits, and what goes with each, column by column: no
    more bytes than grams ask for, however few there are."""
    return b"".join([np.int32(len(grams)).tobytes(), grams.astype("<u4").tobytes(), (grams >> np.uint64(32)).astype("<u2").tobytes(), *(m.tobytes() for m in more)])


def _unpacked(blob: bytes) -> tuple[np.ndarray, int]:
    """(grams, bytes that they take)."""
    n = int(np.frombuffer(blob, "<i4", 1)[0])
    low, high = np.frombuffer(blob, "<u4", n, 4), np.frombuffer(blob, "<u2", n, 4 + 4 * n)
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), 4 + 6 * n


def _rank(groups: np.ndarray) -> np.ndarray:
    """The order of groups: those of rows without id are all last."""
    return np.minimum(groups, NULLS)


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


SENT = {"g": pa.int64(), "p": pa.int32(), "blob": pa.binary()}
REPLY = {"g": pa.int64(), "p": pa.int32(), "step": pa.int32(), "blob": pa.binary()}
SENT_SCHEMA, REPLY_SCHEMA = "g long, p int, blob binary", "g long, p int, step int, blob binary"


def _grams(docs: pa.Table, length: int, gram: int, parts: int) -> pa.Table:
    """Step 1 of a group: its distinct grams, to their parts."""
    group = Group(docs, length, gram, parts)
    grams = group.grams()
    return _table([(group.group, p, _packed(grams[a:b])) for p, a, b in group.by_part(grams)], **SENT)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _shared(blobs: pa.Table) -> pa.Table:
    """Reply 1 of a part: for each gram of each group, whether another group has it."""
    blobs = blobs.sort_by("g")
    grams = [_unpacked(b)[0] for b in blobs.column("blob").to_pylist()]
    key, sizes = np.concatenate(grams), [len(g) for g in grams]
    order = np.argsort(key, kind="stable")
    heads = _runs(key[order])
    several = np.empty(len(key), bool)
    several[order] = np.repeat(np.diff(np.append(heads, len(key))) > 1, np.diff(np.append(heads, len(key))))
    ends = np.cumsum(sizes)
    rows = zip(blobs.column("g").to_pylist(), blobs.column("p").to_pylist(), sizes, ends, strict=True)
    return _table([(g, p, 1, np.packbits(several[e - n : e]).tobytes()) for g, p, n, e in rows if several[e - n : e].any()], **REPLY)


def _replied(replies: pa.Table, step: int) -> dict[int, bytes]:
    rows = zip(*(replies.column(c).to_pylist() for c in ("p", "step", "blob")), strict=True)
    return {p: blob for p, s, blob in rows if s == step}


def _told(grams: np.ndarray, parts: int, replies: dict[int, bytes], kind: np.dtype | None = None) -> np.ndarray:
    """What the replies say of sorted grams or of contexts in their order: bits, or numbers."""
    told = np.zeros(len(grams), bool if kind is None else kind)
    for p, a, b in _by_part(grams, parts):
        if p in replies:
            blob = np.frombuffer(replies[p], np.uint8 if kind is None else kind)
            told[a:b] = np.unpackbits(blob, count=b - a).astype(bool) if kind is None else blob
    return told


def _signatures(docs: pa.Table, replies: pa.Table, length: int, gram: int, parts: int) -> pa.Table:
    """Step 2 of a group: for the contexts of shared grams, the gram and a hash of the context."""
    if not docs.num_rows or not replies.num_rows:
        return _table([], **SENT)
    group = Group(docs, length, gram, parts)
    grams = group.grams()
    group.keep_grams(grams[_told(grams, parts, _replied(replies, 1))])
    _, sample, _, around = group.contexts()
    own = group.gram[sample]
    return _table([(group.group, p, _packed(own[a:b], around[a:b])) for p, a, b in group.by_part(own)], **SENT)


def _compared(blobs: pa.Table) -> pa.Table:
    """Reply 2 of a part: ALL, PARTLY, NEEDED or nothing for each context of each group."""
    blobs = blobs.sort_by("g")
    grams, arounds = [], []
    for blob in blobs.column("blob").to_pylist():
        own, at = _unpacked(blob)
        grams.append(own)
        arounds.append(np.frombuffer(blob, np.uint64, len(own), at))
    sizes = [len(g) for g in grams]
    key, around, group = np.concatenate(grams), np.concatenate(arounds), np.repeat(_rank(blobs.column("g").to_numpy()), sizes)
    order = np.lexsort((group, around, key))
    key, around, group = key[order], around[order], group[order]
    alike = _runs(key, around)
    first = group == np.repeat(group[alike], np.diff(np.append(alike, len(key))))
    heads = _runs(key)
    per_gram = np.diff(np.append(heads, len(key)))
    earlier = np.repeat(np.minimum.reduceat(group, heads), per_gram) < group
    partly = first & earlier
    latest = np.repeat(np.maximum.reduceat(np.where(partly, group, -1), heads), per_gram)
    code = np.where(~first, ALL, np.where(partly, PARTLY, np.where(latest > group, NEEDED, 0))).astype(np.uint8)
    told = np.empty(len(code), np.uint8)
    told[order] = code
    ends = np.cumsum(sizes)
    rows = zip(blobs.column("g").to_pylist(), blobs.column("p").to_pylist(), sizes, ends, strict=True)
    return _table([(g, p, 2, told[e - n : e].tobytes()) for g, p, n, e in rows if told[e - n : e].any()], **REPLY)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _contexts(docs: pa.Table, replies: pa.Table, length: int, gram: int, parts: int) -> pa.Table:
    """Step 3 of a group: the bytes of the contexts that differ from earlier ones of their gram, and
    of those that later groups need."""
    if not docs.num_rows or not replies.num_rows:
        return _table([], **SENT)
    group = Group(docs, length, gram, parts)
    grams = group.grams()
    group.keep_grams(grams[_told(grams, parts, _replied(replies, 1))])
    _, sample, _, _ = group.contexts()
    sample = sample[_told(group.gram[sample], parts, _replied(replies, 2), np.uint8) >= PARTLY]
    own, starts, sizes = group.gram[sample], group.start[sample], group.count[sample] + length - 1
    return _table([(group.group, p, _packed(own[a:b], sizes[a:b].astype(np.uint8), _gathered(group.data, starts[a:b], sizes[a:b]))) for p, a, b in group.by_part(own)], **SENT)


def _ranks(pairs: np.ndarray) -> np.ndarray:
    """The bucket of each value: how many smaller distinct values there are."""
    order = np.argsort(pairs)
    ranks = np.empty(len(pairs), np.uint64)
    ranks[order] = np.cumsum(np.concatenate(([False], pairs[order][1:] != pairs[order][:-1])))[: len(pairs)]
    return ranks


def refined(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of depth `length`: places with equal numbers start equal strings of that
    length (where so many bytes follow). Grams of 8 bytes are the first buckets; each round splits
    buckets of depth d by the bucket pointer d places further on, or at the depth that is still
    missing, and the refined pointers serve the next round."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    depth = min(8, length)
    value = np.zeros(len(data), np.uint64)
    for k in range(depth):
        value = (value << np.uint64(8)) | padded[k : k + len(data)]
    bucket = _ranks(value)
    while depth < length:
        step = min(depth, length - depth)
        later = np.concatenate([bucket[step:], np.zeros(min(step, len(bucket)), np.uint64)])
        bucket = _ranks(bucket * np.uint64(len(bucket) + 1) + later)
        depth += step
    return bucket


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gram: np.ndarray, length: int):
    """Contexts in chunks of whole grams, and for each string of a chunk (context, place in it, bucket)."""
    order = np.argsort(gram, kind="stable")
    filled, sorted_gram, at = np.cumsum(sizes[order]), gram[order], 0
    while at < len(order):
        last = max(at + 1, int(np.searchsorted(filled, filled[at] + POSITIONS, "right")))
        last = int(np.searchsorted(sorted_gram, sorted_gram[last - 1], "right"))
        some = order[at:last]
        ends, strings = np.cumsum(sizes[some]), sizes[some] - length + 1
        which = np.repeat(np.arange(len(some)), strings)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
        bucket = refined(_gathered(data, starts[some], sizes[some]), length)[(ends - sizes[some])[which] + nth]
        yield some[which], nth, bucket
        at = last


def _smallest(bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the least value of its bucket."""
    order = np.argsort(bucket, kind="stable")
    heads = _runs(bucket[order])
    found = np.empty(len(bucket), value.dtype)
    found[order] = np.repeat(np.minimum.reduceat(value[order], heads), np.diff(np.append(heads, len(order))))
    return found


def _judged(blobs: pa.Table, length: int) -> pa.Table:
    """Reply 3 of a part: for each context that was sent 32 bits, for which of its strings an
    earlier group has an equal one."""
    blobs = blobs.sort_by("g")
    grams, sizes, texts = [], [], []
    for blob in blobs.column("blob").to_pylist():
        own, at = _unpacked(blob)
        grams.append(own)
        sizes.append(np.frombuffer(blob, np.uint8, len(own), at).astype(np.int64))
        texts.append(np.frombuffer(blob, np.uint8, -1, at + len(own)))
    per_group = [len(g) for g in grams]
    gram, size, data = np.concatenate(grams), np.concatenate(sizes), np.concatenate(texts)
    group = np.repeat(_rank(blobs.column("g").to_numpy()), per_group)
    starts, masks = np.cumsum(size) - size, np.zeros(len(gram), np.uint32)
    for which, nth, bucket in _strings(data, starts, size, gram, length):
        earlier = _smallest(bucket, group[which]) < group[which]
        np.bitwise_or.at(masks, which[earlier], np.uint32(1) << nth[earlier].astype(np.uint32))
    ends = np.cumsum(per_group)
    rows = zip(blobs.column("g").to_pylist(), blobs.column("p").to_pylist(), per_group, ends, strict=True)
    return _table([(g, p, 3, masks[e - n : e].tobytes()) for g, p, n, e in rows if masks[e - n : e].any()], **REPLY)


def _removed(docs: pa.Table, replies: pa.Table, length: int, gram: int, parts: int, text: bool) -> pa.Table:
    """What is removed of each document of a group, and what stays."""
    group = Group(docs, length, gram, parts)
    grams = group.grams()
    order = np.lexsort((group.ids[group.row], group.gram))
    heads = _runs(group.gram[order]) if len(order) else np.zeros(0, int)
    sorted_ids = group.ids[group.row][order]
    local = sorted_ids[heads] != sorted_ids[np.append(heads[1:], len(order)) - 1] if len(heads) else np.zeros(0, bool)
    shared = _told(grams, parts, _replied(replies, 1))
    group.keep_grams(grams[shared | local])
    which, sample, least, _ = group.contexts()
    own = group.gram[sample]
    is_shared, is_local = (flag[np.searchsorted(grams, own)] if len(own) else np.zeros(0, bool) for flag in (shared, local))
    code = np.zeros(len(sample), np.uint8)
    code[is_shared] = _told(own[is_shared], parts, _replied(replies, 2), np.uint8)
    sent = code >= PARTLY
    masks = np.zeros(len(sample), np.uint32)
    masks[sent] = _told(own[sent], parts, _replied(replies, 3), np.uint32)
    earliest = np.full((len(sample), max(1, length - gram + 1)), LAST)
    mine = np.flatnonzero(is_local & (code != ALL))
    for which_local, nth, bucket in _strings(group.data, group.start[sample][mine], group.count[sample][mine] + length - 1, own[mine], length):
        earliest[mine[which_local], nth] = _smallest(bucket, least[mine[which_local]])
    ids = group.ids[group.row]
    edges = np.zeros(len(group.data) + 1, np.int32)
    for nth in range(int(group.count.max(initial=0))):
        gone = (nth < group.count) & ((code[which] == ALL) | (masks[which] >> np.uint32(nth) & np.uint32(1)).astype(bool) | (earliest[which, nth] < ids))
        edges[group.start[gone] + nth] += 1
        edges[group.start[gone] + nth + length] -= 1
    covered = np.cumsum(edges[:-1], dtype=np.int32) > 0
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    inner = group.bounds[:-1][group.bounds[:-1] < len(covered)]
    begins[inner] = covered[inner]
    rows = []
    for a, b in zip(group.bounds[:-1].tolist(), group.bounds[1:].tolist(), strict=True):
        kept = group.data[a:b][~covered[a:b]].tobytes()
        rows.append((b - a, b - a - len(kept), int(begins[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept))
    made = {"_id": pa.array(group.ids, mask=group.null)}
    for k, (name, kind) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))):
        if text or name != "kept":
            made[name] = pa.array([r[k] for r in rows], kind)
    return pa.table(made)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", text: bool = False, group_bytes: int = GROUP_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which also starts in a row with a
    smaller id; strings are judged on the input, overlaps count, and texts are UTF-8 bytes.

    Returns (id, n_bytes, n_removed, n_spans, kept_sha256), and with `text` the `kept` bytes. Null
    texts are empty. Rows with a null id count as later than all others and, like rows with one
    id, not as repeats of each other. An empty table gives no rows; other columns are ignored.

    Texts are dealt once into groups of neighbouring ids, bounded by bytes and rows, and kept with
    the places of their grams in a table that is bucketed by group. First buckets: each string is
    assigned to the gram of least hash in it; a group sends each of its grams once, packed, to the
    gram's part, and learns which of them other groups have. Of these it sends digests of the
    contexts, most of which are whole in an earlier group (by 112 bits of gram and context) or
    differ from all. Only contexts that share a gram and differ meet with their bytes, all equal
    strings in one place, where buckets are refined by the bucket pointers of later offsets down to
    whole strings, exactly; within a group the same refinement compares documents. The replies, a
    few bits for a context, go back to the groups, which cut their texts. A passage that very many
    documents share is sent once by each group, not by each document. There are as many buckets and
    parts as shuffle partitions, or a fixed multiple; what is sent has a gram at least in each row
    and some 6 bytes for it, so it grows with the input, however many groups and parts there are.
    Rows with one id, if it isn't null, are one group, whatever their size."""
    spark = docs.sparkSession
    if not 8 <= gram <= length or length - gram >= 32 or 2 * length - gram > 255:
        raise ValueError("a gram has 8 bytes at least and 31 less than the string at most")
    folder, name = files.shared_folder(spark, "texts"), f"texts_{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    order = [F.coalesce("_id", F.lit(LAST)), F.when(F.col("_id").isNull(), F.xxhash64("_text")).otherwise(F.lit(0))]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(F.col("_id").isNull(), "_id")
    grouped = dealt.mapInArrow(_grouped(length, gram, group_bytes, group_rows), "g long, r int, _id long, _text binary, _runs binary")
    buckets = min(PARTS * partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    grouped.write.bucketBy(buckets, "g").option("path", folder).format("parquet").saveAsTable(name)
    how = (length, gram, min(PARTS * partitions(spark), MOST_PARTS))
    try:
        texts = spark.table(name)
        met = texts.groupBy("g").applyInArrow(lambda t: _grams(t, *how), SENT_SCHEMA)
        replies = cut(met.groupBy("p").applyInArrow(_shared, REPLY_SCHEMA))
        met = texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda t, r: _signatures(t, r, *how), SENT_SCHEMA)
        replies = replies.unionByName(cut(met.groupBy("p").applyInArrow(_compared, REPLY_SCHEMA)))
        met = texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda t, r: _contexts(t, r, *how), SENT_SCHEMA)
        replies = replies.unionByName(cut(met.groupBy("p").applyInArrow(lambda t: _judged(t, length), REPLY_SCHEMA)))
        schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text else "")
        found = cut(texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda t, r: _removed(t, r, *how, text), schema))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        files.remove(spark, folder)
    return found.withColumnRenamed("_id", id_col)
