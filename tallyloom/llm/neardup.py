"""Exact Jaccard similarity of word shingles: sketches, candidates from MinHash bands, confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, running
from .words import Lexer, distinct, mixed, slices, spans_hash

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of minima; a pair of similarity s shares a band with chance 1 - (1 - s^ROWS)^BANDS, 1 - 5e-8 at 0.8.
BANDS, ROWS = 32, 4
#: Members of a bucket up to which every pair is looked at; a larger one is linked in blocks, which overlap, before
#: tiles of so many shingles a side compare what those left apart.
_FEW, _BLOCK, _STEP = 8, 512, 384
#: Large buckets of a member, the largest ones, in whose blocks it is linked.
_LARGEST = 3
_VOLUME = 1 << 19
#: Pairs of a member up to which each is looked at on its own.
_SINGLY = 40
_PART = 4096
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of bytes other than white space; A-Z count as a-z.
_WORDS = Lexer(_SPACE)
_rng = np.random.default_rng(50)
_FACTOR = _rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDEND = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_WEIGHT = _rng.integers(1 << 62, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(128-bit digest of all words in order, sorted hashes of the distinct shingles) for each text; one
    of fewer than `shingle` words has itself as its only shingle, one without words has none."""
    for first, last, data, offsets in slices(column):
        starts, ends, row = _WORDS.words(data, offsets)
        words = _WORDS.hashes(data, starts, ends)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        tops = bounds[1:][row]
        at = np.arange(len(words))
        begins = (at + shingle <= tops) | (at == bounds[:-1][row])
        at, of = at[begins], row[begins]
        hashes = spans_hash(words, at, np.minimum(at + shingle, tops[begins]), 3)
        cuts = np.searchsorted(of, np.arange(last - first + 1))
        for k in range(last - first):
            yield xxhash.xxh3_128_digest(words[bounds[k] : bounds[k + 1]].tobytes()), distinct(hashes[cuts[k] : cuts[k + 1]])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minima of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PART):
        low = np.minimum(low, (hashes[at : at + _PART] * _FACTOR[:, None] + _ADDEND[:, None]).min(axis=1))
    return mixed((mixed(low).reshape(BANDS, ROWS) * _WEIGHT).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes: the bits that over half of them have, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        counts += np.unpackbits(mixed(hashes[at : at + _PART]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(np.int64)[0])


#: What `sketches` returns besides `_id` and `_mark`: a digest of the words, the number of shingles, their SimHash and band keys.
SKETCH = "_words binary, _size int, _sim long, _keys array<long>"


def sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [(whole, len(hashes), majority(hashes), band_keys(hashes)) for whole, hashes in _sets(batch.column("_text"), shingle)]
            keys = pa.array(np.concatenate([m[3] for m in made]).view(np.int64))
            found = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_mark"), *found, pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), keys)], ["_id", "_mark", "_words", "_size", "_sim", "_keys"])

    return run


def shingles(shingle: int):
    """(node, band keys, sorted hashes of the distinct shingles) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [hashes for _, hashes in _sets(batch.column("_text"), shingle)]
            bounds = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("keys"), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "keys", "hashes"])

    return run


def _candidates(similarity: float):
    """Pairs of small buckets (block null), and members of blocks of large ones, with the bucket's key and members and
    the member's size (b null)."""

    def bucket(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        members = np.diff(bounds)
        a, b, block, of, size = [], [], [], [], []
        for lag in range(1, _FEW):
            at = np.concatenate([bounds[:-1][(members > lag + k) & (members <= _FEW)] + k for k in range(_FEW - lag)])
            x, y = sizes[at], sizes[at + lag]
            at = at[np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9]
            a.append(np.minimum(nodes[at], nodes[at + lag]))
            b.append(np.maximum(nodes[at], nodes[at + lag]))
        none = sum(len(x) for x in a)
        for k in np.flatnonzero(members > _FEW):
            for low in range(bounds[k], bounds[k + 1], _STEP):
                top = min(low + _BLOCK, bounds[k + 1])
                a.append(nodes[low:top])
                block.append(np.full(top - low, mixed(keys[low : low + 1].view(np.uint64) + np.uint64(low - bounds[k]))[0]).view(np.int64))
                of.append(np.stack([np.full(top - low, keys[low]), np.full(top - low, members[k])]))
                size.append(sizes[low:top])
                if top == bounds[k + 1]:
                    break
        a, n = np.concatenate(a), sum(len(x) for x in block)
        missing = lambda head, tail: np.concatenate([np.full(head, False), np.full(tail, True)])
        second = pa.array(np.concatenate([*b, np.zeros(n, np.int64)]), pa.int64(), mask=missing(none, n))
        blocks = pa.array(np.concatenate([np.zeros(none, np.int64), *block]), pa.int64(), mask=~missing(none, n))
        buckets, counts = (pa.array(x, pa.int64(), mask=~missing(none, n)) for x in np.concatenate([np.zeros((2, none), np.int64), *of], axis=1))
        own = pa.array(np.concatenate([np.zeros(none, np.int32), *size]), pa.int32(), mask=~missing(none, n))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), second, blocks, buckets, counts, own], ["a", "b", "block", "bucket", "members", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            if whole:
                yield bucket(*[h[:whole] for h in held])
                held = [h[whole:].copy() for h in held]
        if len(held[0]):
            yield bucket(*held)

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def spanning(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what links of at least `similarity` connect. Each member is compared with
    those that no other has reached yet."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    starts = np.cumsum(sizes) - sizes
    mark, edges, rest = np.zeros(codes.max(initial=0) + 1, bool), [], np.ones(len(sets), bool)
    queue: list[int] = []
    while rest.any():
        if not queue:
            queue = [int(rest.argmax())]
            rest[queue[0]] = False
        member = queue.pop()
        mine = codes[starts[member] : starts[member] + sizes[member]]
        mark[mine] = True
        both = np.bincount(owner[mark[codes]], minlength=len(sets))
        mark[mine] = False
        near = np.flatnonzero(rest & (both >= similarity * (sizes + sizes[member] - both) - 1e-9))
        edges += [(member, int(k)) for k in near]
        queue += near.tolist()
        rest[near] = False
    return edges


def _blocks(similarity: float):
    def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        edges = spanning(sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch in batches:
            lists = batch.column("hashes")
            flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for k, (block, node) in enumerate(zip(batch.column("block").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if block != now and nodes:
                    yield links(nodes, sets)
                    nodes, sets = [], []
                now = block
                nodes.append(node)
                sets.append(flat[bounds[k] : bounds[k + 1]].view(np.uint64).copy())
        if nodes:
            yield links(nodes, sets)

    return run


def band_candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, block, bucket, members, size) over `classes` (node, _size, _keys): every pair of a small bucket that the
    numbers of shingles allow (block null), and the members of blocks of a large one (b null) with the
    number of its members and their own of shingles, ordered by the next band so that what is near lies
    together. Blocks alone miss pairs: `left_apart` compares the others."""
    following = F.concat(F.slice("_keys", 2, BANDS - 1), F.slice("_keys", 1, 1))
    keyed = classes.select("node", F.col("_size").alias("size"), F.explode(F.arrays_zip(F.col("_keys").alias("key"), following.alias("next"))).alias("k")).select("k.key", "node", "size", "k.next")
    dealt = keyed.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "next", "node").select("key", "node", "size")
    return dealt.mapInArrow(_candidates(similarity), "a long, b long, block long, bucket long, members long, size int")


def largest_blocks(found: DataFrame) -> DataFrame:
    """(block, node): of what `band_candidates` found the blocks of each member's largest buckets. Copies that are near
    share most of their buckets, and a few of them link what all would; what they don't is for `left_apart`."""
    order = Window.partitionBy("a").orderBy(F.desc("members"), "bucket")
    ranked = found.where("block is not null").withColumn("place", F.dense_rank().over(order))
    return ranked.where(F.col("place") <= _LARGEST).select("block", F.col("a").alias("node"))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) are at least so similar."""
    side = lambda a, x: sets.select(F.col("node").alias(a), F.col("hashes").alias(x))
    both = F.size(F.array_intersect("x", "y"))
    near = both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(near).select("a", "b")


def linked_blocks(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what is similar within each block (block, node)."""
    dealt = blocks.join(sets.select("node", "hashes"), "node").select("block", "node", "hashes").repartition(partitions(blocks.sparkSession), "block")
    return dealt.sortWithinPartitions("block").mapInArrow(_blocks(similarity), "a long, b long")


def _tiles(similarity: float):
    """Edges between sets of different groups on the two sides of a tile: of all pairs that this bucket is the first
    to hold. An edge that joins groups which others have joined already isn't made."""

    def links(side: np.ndarray, nodes: np.ndarray, roots: np.ndarray, band: np.ndarray, keys: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), sizes)
        ends = np.cumsum(sizes)
        group = np.unique(roots, return_inverse=True)[1]
        mark, edges = np.zeros(codes.max(initial=0) + 1, bool), []
        lone = side.min() == side.max()  # a block with itself
        for k in np.flatnonzero(side == side.min()).tolist():
            wanted = (group != group[k]) & (np.minimum(sizes, sizes[k]) >= similarity * np.maximum(sizes, sizes[k]) - 1e-9)
            wanted[: k + 1 if lone else 0] = False
            if not lone:
                wanted &= side != side[k]
            at = np.flatnonzero(wanted)
            if len(at):
                at = at[~(keys[at, : band[k]] == keys[k, : band[k]]).any(axis=1)]  # an earlier band's bucket holds those
            if not len(at):
                continue
            mine = codes[ends[k] - sizes[k] : ends[k]]
            mark[mine] = True
            if len(at) <= _SINGLY:
                both = np.array([np.count_nonzero(mark[codes[ends[j] - sizes[j] : ends[j]]]) for j in at.tolist()])
            else:
                both = np.bincount(owner[mark[codes]], minlength=len(sets))[at]
            mark[mine] = False
            for j in at[both >= similarity * (sizes[at] + sizes[k] - both) - 1e-9].tolist():
                if group[j] != group[k]:
                    edges.append((nodes[k], nodes[j]))
                    group[group == group[j]] = group[k]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            lists = batch.column("hashes")
            flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            tiles = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "low", "high")], strict=True))
            side, node, root, band = (batch.column(c).to_numpy() for c in ("block", "node", "root", "band"))
            keys = batch.column("keys").flatten().to_numpy().reshape(-1, BANDS)
            for k, tile in enumerate(tiles):
                if tile != now and held:
                    yield links(*[np.array([h[c] for h in held]) for c in range(5)], [h[5] for h in held])
                    held = []
                now = tile
                held.append((side[k], node[k], root[k], band[k], keys[k].copy(), flat[bounds[k] : bounds[k + 1]].copy()))
        if held:
            yield links(*[np.array([h[c] for h in held]) for c in range(5)], [h[5] for h in held])

    return run


def left_apart(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Edges (a, b) between members of one large bucket (bucket, node, size) whose groups, by `roots` (node, root) of
    the links found so far, differ; None if there are no such members. `sets` are (node, keys, hashes).

    Every pair of them is compared exactly once: in the first bucket that holds both. A bucket's
    members are put in order, the largest group first, and cut into blocks of so many shingles; a tile is two blocks, or
    one with itself. Blocks of one group alone don't meet, so many copies of one text cost what is not among
    them, and only a family whose members are not linked costs its square, dealt into tiles. Each tile
    is a key of its own: no task holds more than two blocks."""
    spark = members.sparkSession
    named = members.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    named = cut(named)
    several = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    shares = cut(named.join(several, "bucket", "left_semi").groupBy("bucket", "root").agg(F.count("*").alias("n")))
    if not shares.take(1):
        return None
    own = named.join(shares, ["bucket", "root"]).withColumn("rare", -F.col("n"))
    placed = cut(running(own, ["bucket", "rare", "root", "node"], {"before": (F.col("size") + 16).cast("long")}))
    starts = placed.groupBy("bucket").agg(F.min("before").alias("start"))  # a bucket's blocks begin where it begins
    placed = cut(placed.join(starts, "bucket").select("bucket", "node", "root", F.floor((F.col("before") - F.col("start")) / _VOLUME).alias("block")))
    blocks = cut(placed.groupBy("bucket", "block").agg(F.min("root").alias("x"), F.max("root").alias("y")))
    alike = blocks.where("x = y").groupBy("bucket", F.col("x").alias("root")).agg(F.min("block").alias("from"), F.max("block").alias("to"))
    ends = blocks.groupBy("bucket").agg(F.min("block").alias("lowest"), F.max("block").alias("highest"))
    pure = blocks.where("x = y").select("bucket", "block", F.col("x").alias("root")).join(alike, ["bucket", "root"]).select("bucket", "block", "from", "to")
    others = blocks.select("bucket", "block").join(ends, "bucket").join(pure, ["bucket", "block"], "left")
    met = others.withColumn("other", F.explode(F.sequence("lowest", "highest"))).where("from is null or not other between from and to")
    tiles = met.select("bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    band = (F.array_position("keys", F.col("bucket")) - 1).cast("int").alias("band")
    asked = placed.join(tiles, ["bucket", "block"]).join(sets, "node").select("bucket", "low", "high", "block", "node", "root", band, "keys", "hashes")
    dealt = asked.repartition(partitions(spark), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "block")
    return dealt.mapInArrow(_tiles(similarity), "a long, b long")
