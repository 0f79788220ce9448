"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this, so no source gets more than this times its size.
REPEATS = 3
#: Documents balanced together, about.
CHUNK = 2_000
_EDGE = 1e-9
#: Corrections of one or two documents to a chunk that lands, at most.
_REPAIRS = 8


def _draw(*key) -> float:
    """A number in [0, 1) that depends on the key alone."""
    return int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:7], "big") / (1 << 56)


def flight(sizes: list[int], chances: list[float], key) -> list[float]:
    """Move chances along the null space of the two totals (of chances, and of sizes weighted by
    them) until at most two are fractional.

    Three fractional units at a time: the cross product of (1, 1, 1) and their sizes keeps both
    totals, or any difference of two where their sizes are equal. Of the two ways to the border one is
    drawn so that each unit keeps its chance in expectation."""
    chances, open_units = list(chances), []
    for unit, chance in enumerate(chances):
        if _EDGE < chance < 1 - _EDGE:
            open_units.append(unit)
        while len(open_units) >= 3:
            a, b, c = open_units[-3:]
            move = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(move):
                move = (1, -1, 0)
            up = down = float("inf")
            for i, m in zip((a, b, c), move, strict=True):
                if m:
                    to_one, to_zero = (1 - chances[i]) / abs(m), chances[i] / abs(m)
                    up, down = min(up, to_one if m > 0 else to_zero), min(down, to_zero if m > 0 else to_one)
            step = up if _draw(key, unit, len(open_units)) * (up + down) < down else -down
            for i, m in zip((a, b, c), move, strict=True):
                chances[i] = min(1.0, max(0.0, chances[i] + step * m))
            still = [i for i in (a, b, c) if _EDGE < chances[i] < 1 - _EDGE]
            open_units[-3:] = still if len(still) < 3 else still[:2]
    return [float(round(p)) if not _EDGE < p < 1 - _EDGE else p for p in chances]


def landing(sizes: list[int], chances: list[float], key) -> list[float]:
    """Decide the few units that are left: the choice that comes nearest to the expected size, then
    to the expected count, then by a draw. What a long document still leaves or exceeds is made
    up for by few other units, one or two at a time, that bring the size nearest."""
    left = [i for i, p in enumerate(chances) if _EDGE < p < 1 - _EDGE]
    size, count = sum(sizes[i] * chances[i] for i in left), sum(chances[i] for i in left)
    best = min(
        product((0, 1), repeat=len(left)),
        key=lambda x: (abs(sum(sizes[i] * v for i, v in zip(left, x, strict=True)) - size), abs(sum(x) - count), _draw(key, x)),
        default=(),
    )
    decided = list(chances)
    for i, v in zip(left, best, strict=True):
        decided[i] = float(v)
    excess = sum(sizes[i] * decided[i] for i in left) - size
    effect = np.array(sizes, float) * np.where(np.array(decided) > 0.5, -1, 1)
    for _ in range(_REPAIRS):
        order = np.argsort(effect, kind="stable")
        inorder = effect[order]
        near = np.searchsorted(inorder, -excess - inorder)
        tries = [(np.abs(excess + inorder), None)]
        for at in (near - 1, near):
            mate = np.clip(at, 0, len(order) - 1)
            tries.append((np.where(mate == np.arange(len(order)), np.inf, np.abs(excess + inorder + inorder[mate])), mate))
        errors, mate = min(tries, key=lambda t: t[0].min(initial=np.inf))
        if errors.min(initial=np.inf) >= abs(excess) - 0.5:
            break
        i = int(errors.argmin())
        for unit in {int(order[i]), int(order[i if mate is None else mate[i]])}:
            excess += effect[unit]
            effect[unit] = -effect[unit]
            decided[unit] = 1.0 - round(decided[unit])
    return [float(round(p)) for p in decided]


def _balance(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["_mark", "_size"], kind="stable").reset_index(drop=True)
    key = (int(group["_mark"].iloc[0]), len(group))
    sizes, chances = group["_size"].tolist(), group["_chance"].tolist()
    moved = flight(sizes, chances, key)
    group["_chance"] = landing(sizes, moved, key) if group["_last"].iloc[0] else moved
    return group.drop(columns="_chunk")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds `target` to one row for each source (`source`, `source_size`): weights repeat over the
    sources by code point, null last, and share the total size; a target stops at `repeats` times
    the source's size, and the excess is shared by weight again until none is above.

    The level that all open targets have for each unit of weight only rises, so a few rounds of
    two sums decide which sources are capped; nothing but those sums reaches the driver."""
    ranked = running(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], {})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row") % len(weights)).cast("int") + 1)
    weighed = cut(ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size").cast("double") * repeats))
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("_cap") <= F.col("_weight") * level
        caps, open_weight = weighed.agg(F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0))).first()
        raised = (total - caps) / open_weight if open_weight else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return weighed.select("source", "source_size", F.least("_cap", F.col("_weight") * level).alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds `_mark`, a hash that tells rows apart whatever partitions they lie in, and `_row`, which
    only names them. Rows alike in id, source and size are interchangeable and numbered from 0: counted in
    each partition, numbered by those counts, and made again, so a key that most rows have stays
    in as many pieces as there are partitions."""
    alike = ["_id", "source", "_size"]
    pieces = rows.withColumn("_part", F.spark_partition_id()).groupBy("_part", *alike).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*alike).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    single = pieces.select(*alike, "_n", offset.alias("_offset")).select(*alike, F.explode(F.sequence(F.col("_offset"), F.col("_offset") + F.col("_n") - 1)).alias("_nth"))
    return single.select(*alike, F.xxhash64("_id", "source", "_size", "_nth", F.lit(7)).alias("_mark"), F.monotonically_increasing_id().alias("_row"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of every row of `docs` a mix takes in which each source has its target.

    Size is the number of words between white space (null: 0). Every document of a source has the
    same expected number of copies, its source's target over its size; whole copies are taken, and
    the fraction is an inclusion chance that the cube method turns into a choice which keeps the
    source's total of words and of documents. Documents without words have nothing to balance and
    are never taken more than their whole copies. Null is a source of its own, the last; an empty
    table gives no rows, an empty source has target 0. Repeated rows and ids each keep their row, and
    all choices depend on ids, sources and sizes alone, so reruns agree, however rows are partitioned. Other columns are ignored.
    Returns (id, size, source_size, target, taken).

    A source is balanced in chunks, dealt by a hash of id, size and number among equals, each of which leaves at most two
    documents open; these are gathered and balanced again until all that is open of a source fits one
    chunk. That lands in the same round, whatever other sources do; to a source that was many chunks
    before, about a chunk of its decided documents, by hash, is added, so that landing
    can make up for what is left: a few of the decided documents are then decided anew, so the last
    chunk trades their exact chances for the total. A source that holds most rows is many chunks like any other."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = cut(_numbered(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), size.alias("_size"))))
    planned = targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_docs")), weights, repeats)
    # a source has one row here; its rows find it where they lie while sources are few, else by a shuffle that may be split
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = planned.select(F.col("source").alias("_s"), "source_size", "target", copies.alias("_copies"))
    joined = rows.join(planned, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.floor(F.col("_copies") + _EDGE)
    chance = F.when(F.col("_size") > 0, F.greatest(F.col("_copies") - whole, F.lit(0.0))).otherwise(F.lit(0.0))
    state = cut(joined.withColumn("_whole", whole.cast("long")).withColumn("_chance", chance).drop("_copies"))
    schema = "source string, _size long, _mark long, _row long, _chance double, _last boolean"
    columns = ["source", "_size", "_mark", "_row", "_chance"]
    is_open = F.col("_chance").between(_EDGE, 1 - _EDGE)
    pending, landed, settled = state.where(is_open).select(columns), [], None
    while True:
        counts = pending.groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("_chunks"))
        most = counts.agg(F.max("_chunks")).first()[0]
        if most is None:
            break
        counts = counts.select(F.col("source").alias("_s"), "_chunks", (F.col("_chunks") <= 1).alias("_last"))
        given = pending
        if settled is not None:
            # partners of what lands now; they leave the decided ones and come back with it
            have = settled.groupBy("source").agg(F.count("*").alias("_have")).withColumnRenamed("source", "_of")
            shares = counts.where("_last").join(have, F.col("_s").eqNullSafe(F.col("_of"))).select("_s", (F.lit(float(chunk)) / F.col("_have")).alias("_share"))
            lot = settled.join(shares, F.col("source").eqNullSafe(F.col("_s")))
            partners = cut(lot.where(F.pmod(F.xxhash64("_mark", F.lit(11)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).select(columns))
            settled = cut(settled.join(partners.select("_row"), "_row", "left_anti"))
            given = pending.unionByName(partners)
        dealt = given.join(counts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_chunk", F.pmod(F.xxhash64("_mark", F.lit(most)), "_chunks")).drop("_s", "_chunks")
        moved = cut(dealt.groupBy("source", "_chunk").applyInPandas(_balance, schema))
        landed.append(moved.where("_last").select(columns))
        closed = moved.where(~F.col("_last") & ~is_open).select(columns)
        settled = closed if settled is None else settled.unionByName(closed)
        pending = moved.where(~F.col("_last") & is_open).select(columns)
    decided = (settled if settled is not None else pending).select(columns)
    for more in landed:
        decided = decided.unionByName(more)
    chosen = decided.where("_chance > 0.5").select(F.col("_row").alias("_r"))
    taken = F.col("_size") * (F.col("_whole") + F.when(F.col("_r").isNotNull(), 1).otherwise(0))
    return state.join(chosen, F.col("_row") == F.col("_r"), "left").select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))
