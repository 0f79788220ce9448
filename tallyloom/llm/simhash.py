"""SimHash near-duplicates by one-wildcard variants of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import cut, join_hot, partitions, small_batches
from .components import components

BITS = 64
#: Shingles whose bits are counted together.
_CHUNK = 1 << 14
#: Members of a bucket up to which every linked pair is emitted, and up to which it isn't divided.
_FEW, _MANY = 8, 4096


def fingerprint(text: bytes, shingle: int = 3) -> bytes:
    """SimHash of a text, as 8 bytes: A-Z lower-cased, words between white space, every shingle of
    `shingle` words (of fewer words, the whole) hashed by XXH64 with seed 42. A bit is set if it is
    set in over half of the hashes; no words give zero."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return bytes(8)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    last = max(1, len(starts) - shingle + 1)
    starts, ends, digest = starts[:last], ends[shingle - 1 :] or ends[-1:], xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, last, _CHUNK):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > last).tobytes()


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join([fingerprint(t or b"", shingle) for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.frombuffer(found, ">i8").astype(np.int64), pa.int64())], ["_id", "_fp"])

    return run


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit between
    fingerprints that differ by at most `distance` bits."""
    n = distance // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _variants(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part in np.array_split(fps, max(1, len(fps) // 4096)):
                keys, tag = [], 0
                for low, width in segments(distance):
                    segment = (part >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    for bit in range(width):
                        keys.append((segment & ~np.uint64(1 << bit)) ^ np.uint64(tag << 56) if width <= 56 else segment & ~np.uint64(1 << bit))
                        tag += 1
                    if width > 56:
                        raise ValueError("a distance of 0 or 1 needs no variants")
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.tile(part, len(keys)).view(np.int64))], ["key", "fp"])

    return run


def _spanning(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links within `distance` connect, one for each member at most. Each
    member is compared with those that no other has reached yet."""
    edges, rest = [], fps
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            members = queue.pop()
            for member in members:
                near = np.bitwise_count(rest ^ member) <= distance
                if near.any():
                    queue.append(rest[near])
                    edges.append((np.full(int(near.sum()), member), rest[near]))
                    rest = rest[~near]
    return edges


def _divided(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Groups of a large bucket, one of which holds both ends of every link: of the bits in which members
    differ, divided into one share more than may differ, two ends agree in one share at least."""
    bits = np.flatnonzero(np.bitwise_or.reduce(fps ^ fps[0]) >> np.arange(BITS, dtype=np.uint64) & np.uint64(1))
    if len(fps) <= _MANY or len(bits) <= distance:
        return [fps]
    groups = []
    for share in np.array_split(bits, distance + 1):
        key = np.zeros(len(fps), np.uint64)
        for bit in share:
            key = key << np.uint64(1) | fps >> np.uint64(bit) & np.uint64(1)
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                groups += _divided(fps[order[a:b]], distance) if b - a < 0.9 * len(fps) else [fps[order[a:b]]]
    return groups


def _linked(distance: int):
    def bucket_edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(bounds)
        pairs = []
        for lag in range(1, _FEW):
            at = np.concatenate([bounds[:-1][(sizes > lag + k) & (sizes <= _FEW)] + k for k in range(_FEW - lag)])
            near = np.bitwise_count(fps[at] ^ fps[at + lag]) <= distance
            pairs.append((fps[at][near], fps[at + lag][near]))
        for k in np.flatnonzero(sizes > _FEW):
            for group in _divided(fps[bounds[k] : bounds[k + 1]], distance):
                pairs += _spanning(group, distance)
        a, b = (np.concatenate([p[i] for p in pairs]).view(np.int64) for i in (0, 1))
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key so far, which may go on

        def ended(more: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, fps = (np.concatenate([h[k] for h in (*held, *more)]) for k in (0, 1))
            held.clear()
            return bucket_edges(keys, fps)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            whole = int(np.searchsorted(keys, keys[-1]))
            if held and held[-1][0][-1] != keys[-1] or whole:
                yield ended([(keys[:whole], fps[:whole])])
            held.append((keys[whole:].copy(), fps[whole:].copy()))
        if held:
            yield ended([])

    return run


def fingerprint_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect what links within `distance` bits connect, over distinct
    fingerprints (one long column).

    Each fingerprint is cut into the fewest segments of which one differs by at most a bit, and
    every segment is indexed once for each of its bits with that bit deleted. Rows with one key
    form a bucket, sorted by Spark, and are verified there. A small bucket emits its linked pairs,
    a larger one a spanning forest of them. Repeated fingerprints give no edge more; none give no rows."""
    keyed = fps.mapInArrow(_variants(distance), "key long, fp long")
    dealt = keyed.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_linked(distance), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint and the group of near-duplicates of every row of `docs`.

    Fingerprints that differ by at most `distance` bits link, and groups are what links connect;
    component_id is the smallest id of the group. Null, empty and blank texts have fingerprint
    zero, which links like any other. Repeated rows and ids each keep their row; rows with a null
    id are in groups but never name one (a group of null ids alone has a null component_id). An
    empty table gives no rows. Other columns of `docs` are ignored.
    Returns (id, fingerprint of 16 hex digits, component_id).

    Equal fingerprints are one class, with a count, before any search, so copies cost one row
    each; links are sought between classes and spread to rows by a join that handles hot classes."""
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(_fingerprints(shingle), f"_id {docs.schema[id_col].dataType.simpleString()}, _fp long"))
    classes = cut(rows.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")))
    roots = components(fingerprint_links(classes.select("_fp"), distance))
    named = classes.join(roots, classes["_fp"] == roots["node"], "left").select("_fp", "_n", "_least", F.coalesce("root", "_fp").alias("_root"))
    named = cut(named)
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    spread = cut(named.join(least, "_root").select("_fp", "_n", "component_id"))
    return join_hot(rows, spread, "_fp", "_n").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, similarity: float = neardup.SIMILARITY, shingle: int = neardup.SHINGLE, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): the group of near-duplicates of every row of `docs`, by fingerprints of
    `shingle` words in a row and the similarity of what they stand for.

    Texts link if their sets of shingles, A-Z lower-cased, words between white space, have a Jaccard
    similarity of at least `similarity`; groups are what links connect, and component_id is the
    smallest id of one (null if none has an id). Texts without words are one group. Repeated rows
    each keep their row; an empty table gives no rows; other columns are ignored.

    Equal words are one class, with a count, before any search. Candidates are the classes with one
    fingerprint, or with fingerprints that one-wildcard variants link, and, as sets that are 0.8
    similar differ in some 9 of 64 bits, those that share a band of minima as well: every pair that does, by
    pairs of a small bucket, and by blocks and then tiles of a large one. All links are confirmed on whole sets."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).withColumn("_mark", F.xxhash64("_text"))
    rows = cut(texts.mapInArrow(neardup.sketches(shingle), f"_id {kind}, _mark long, {neardup.SKETCH}"))
    first = [F.first(c).alias(c) for c in ("_size", "_sim", "_keys")]
    holder = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))).alias("_holder")
    classes = cut(rows.groupBy("_words").agg(holder, F.count("*").alias("_n"), *first).withColumn("node", F.monotonically_increasing_id()))
    sims = cut(classes.groupBy("_sim").agg(F.min("node").alias("first")))
    side = lambda fp, a: sims.select(F.col("_sim").alias(fp), F.col("first").alias(a))
    by_bits = fingerprint_links(sims.select("_sim"), distance).withColumnsRenamed({"a": "x", "b": "y"}).join(side("x", "a"), "x").join(side("y", "b"), "y")
    equal = classes.select("_sim", "node").join(sims, "_sim").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = cut(neardup.band_candidates(classes, similarity))
    pairs = found.where("block is null").select("a", "b").union(by_bits.select(F.least("a", "b"), F.greatest("a", "b"))).union(equal)
    pairs, blocks = cut(pairs.distinct()), neardup.largest_blocks(found)
    members = found.where("block is not null").select("bucket", F.col("a").alias("node"), "size").distinct()
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    # a class's words are read from the row with its least id; copies of it are one row
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("_name")
    chosen = classes.join(wanted, "node", "left_semi").select(F.col("_holder.mark").alias("_mark"), named("_holder.id"), "node", F.col("_keys").alias("keys"))
    one = texts.select("_mark", named("_id"), "_text").join(chosen, ["_mark", "_name"]).groupBy("_mark", "_name", "node").agg(F.first("_text").alias("_text"), F.first("keys").alias("keys"))
    sets = cut(one.select("node", "keys", "_text").mapInArrow(neardup.shingles(shingle), "node long, keys array<long>, hashes array<long>"))
    with small_batches(spark, 64):  # a row is a whole set here
        large = cut(neardup.linked_blocks(blocks, sets, similarity))
    edges = cut(neardup.confirmed(pairs, sets, similarity).unionByName(large))
    roots = components(edges)
    with small_batches(spark, 64):
        apart = neardup.left_apart(members, roots, sets, similarity)
        more = None if apart is None else cut(apart)
    if more is not None and more.take(1):
        roots = components(edges.unionByName(more))
    rooted = classes.select("_words", "_n", "node", F.col("_holder.id").alias("_least")).join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    rooted = cut(rooted.select("_words", "_n", "_least", F.coalesce("root", "node").alias("_root")))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    spread = cut(rooted.join(least, "_root").select("_words", "_n", "component_id"))
    return join_hot(rows.select("_id", "_words"), spread, "_words", "_n").select(F.col("_id").alias(id_col), "component_id")
