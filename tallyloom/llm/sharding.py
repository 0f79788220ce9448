"""Sharding by the smallest feasible capacity over ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, running

#: Group ends that reach the driver in one round, at first, and at most.
DETAIL, MOST = 1 << 15, 1 << 20


class _Digest:
    """Some of the group ends, in order: the largest of each stretch of bytes, and how many ends a
    stretch holds."""

    def __init__(self, rows: list[tuple[int, int]], width: int, anchors: list[int]):
        self.width = width
        self.crowded = {(end - 1) // width for end, n in rows if n > 1}
        self.ends = sorted({0, *anchors, *(end for end, _ in rows)})

    def below(self, limit: int) -> int:
        """The largest known end up to `limit`: the greedy cut comes at least as far."""
        return self.ends[bisect_right(self.ends, limit) - 1]

    def above(self, limit: int) -> int:
        """No end up to `limit` is larger than this: the greedy cut comes no further."""
        at, stretch = bisect_right(self.ends, limit), (limit - 1) // self.width
        hidden = stretch in self.crowded and at < len(self.ends) and (self.ends[at] - 1) // self.width == stretch
        return limit if hidden else self.ends[at - 1]


def _walk(capacity: int, shards: int, step) -> list[int]:
    cuts = [0]
    for _ in range(shards):
        cuts.append(step(cuts[-1] + capacity))
    return cuts


def _least(low: int, high: int, holds) -> int:
    """The least number in (low, high] for which `holds`; it holds for high and from some number on."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def _searched(ends: DataFrame, total: int, low: int, high: int, shards: int) -> list[int]:
    """The same cuts with nothing on the driver but one end at a time: the walk asks Spark for every cut."""

    def step(limit: int) -> int:
        return ends.where(F.col("end") <= limit).agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]

    return _walk(_least(low, high, lambda c: _walk(c, shards, step)[-1] >= total), shards, step)[1:]


def capacity_cuts(ends: DataFrame, total: int, largest: int, shards: int, detail: int = DETAIL, most: int = MOST) -> list[int]:
    """Ends of the shards under the least capacity for which the greedy walk over all group ends
    (column `end`: bytes up to and with the group) needs no more than `shards` shards.

    The search runs on the driver over a bounded digest of the ends, which brackets both the
    capacity and every cut of the walk. Each round looks more closely at the zones where cuts may
    fall, until the walk is exact; a round narrows the zones by about `detail` / `shards` squared,
    and where it doesn't the next one looks twice as closely, with `most` ends at most; where that
    doesn't do, what is left of the search asks for each cut on its own."""
    if total == 0:
        return [0] * shards
    low = max(largest, -(-total // shards)) - 1
    high, zones, anchors = low + largest + 1, [(1, total)], [total]
    while True:
        width = max(1, -(-sum(b - a + 1 for a, b in zones) // detail))
        inside = F.lit(False)
        for a, b in zones:
            inside = inside | F.col("end").between(a, b)
        stretches = ends.where(inside).groupBy(F.expr(f"(end - 1) div {width}")).agg(F.max("end").alias("end"), F.count("*").alias("n"))
        digest = _Digest([(r["end"], r["n"]) for r in stretches.select("end", "n").collect()], width, anchors)
        high = _least(low, high, lambda c: _walk(c, shards, digest.below)[-1] >= total)
        low = _least(low, high, lambda c: _walk(c, shards, digest.above)[-1] >= total) - 1
        nearest, furthest = _walk(low + 1, shards, digest.below), _walk(high, shards, digest.above)
        if nearest == furthest:
            return nearest[1:]
        before = sum(b - a + 1 for a, b in zones)
        zones, anchors = [], [*nearest, *anchors]
        for a, b in sorted(zip(nearest, furthest, strict=True)):
            if zones and a <= zones[-1][1]:
                zones[-1] = (zones[-1][0], max(b, zones[-1][1]))
            else:
                zones.append((a, b))
        if 2 * sum(b - a + 1 for a, b in zones) > before:
            if 2 * detail > most:
                return _searched(ends, total, low, high, shards)
            detail *= 2  # few, large groups: stretches that hold one end each decide


def minimax_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", detail: int = DETAIL) -> DataFrame:
    """Put every row into one of `shards` shards of nearly equal bytes (law `bytes`).

    Rows with equal texts form one atomic group; null texts form one too. Groups are ordered by
    their smallest id (then by text digest), and the shards are runs of that order: a binary
    search finds the least capacity under which the greedy walk fits, and its cuts are the shards.
    Size is the text's UTF-8 bytes plus 1; a null text has size 1 and CRC 0. If one group outweighs
    an equal share, the capacity is that group's size. `slot` counts rows of a shard from 0, in
    group order. Repeated ids stay separate rows; null ids come first. An empty table gives no
    rows. Other columns of `docs` are ignored. Returns (id, size, text_crc32, law, shard, slot).

    DataFrame operations only. Texts are read once; from then on a row is an id, three numbers and
    a 32-byte digest. A row's group is joined with hot groups broadcast, and both orders (bytes
    before a row, rows before a row) come from one range partitioning."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("_size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("_crc"),
            F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), F.lit(b"null")).alias("_text"),
        )
    )
    groups = cut(rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.sum("_size").alias("_bytes")))
    total, largest = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.max("_bytes"), F.lit(0))).first()
    placed = cut(running(join_hot(rows, groups.drop("_bytes"), "_text", "_n"), ["_first", "_text", "_id"], {"before": "_size"}))
    starts = placed.groupBy("_text").agg(F.min("before").alias("start"))
    ends = cut(starts.where("start > 0").select(F.col("start").alias("end")).union(docs.sparkSession.range(1).select(F.lit(total).alias("end"))))
    cuts = capacity_cuts(ends, total, largest, shards, detail)
    shard = sum((F.col("before") >= c).cast("int") for c in cuts[:-1]) if shards > 1 else F.lit(0)
    sharded = placed.withColumn("shard", shard)
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("_start"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("row") - F.col("_start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
