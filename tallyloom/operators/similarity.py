"""Are substitutes nearer in an embedding than random pairs of one group?"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import SEED, draw, ticket
from ..functions.order import running
from ..functions.vectors import pair_cosines

PER_END = 3
# Thresholds of the verdict, replicates, level of the interval, reference means.
MIN_LIFT, REPLICATES, LEVEL, RATIO = 0.05, 10_000, 0.95, 0.5
REFERENCE, TOLERANCE = (0.717, 0.748), 0.02
#: Modulus of the draws that weigh values, and the draws from which a value counts once more: the
#: Poisson distribution of mean 1.
PRIME = (1 << 31) - 1
CUTS = tuple(int(PRIME * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(12))


def random_controls(pairs: DataFrame, grouping: DataFrame, seed: int = SEED, per_end: int = PER_END) -> DataFrame:
    """(pair, anchor, partner): for each end of each pair (pair, a, b) up to `per_end` distinct items
    of its group, neither end of the pair. `grouping` is (item, grp) of the vocabulary.

    Members of all groups are put in a random order once, by ranges; an end takes members from a random
    place on, a random stride apart, so that ends seldom share more than one, a group costs its size
    and not its square, and no group lies in one task."""
    members = running(grouping.select("grp", "item", ticket(seed, "item").alias("_ticket")), ["grp", "_ticket", "item"], {}).drop("_ticket")
    groups = members.groupBy("grp").agg(F.count("*").alias("size"), F.min("row").alias("start"))
    ends = pairs.select("pair", "a", "b", F.explode(F.array("a", "b")).alias("anchor"))
    homes = ends.join(grouping.select(F.col("item").alias("anchor"), "grp"), "anchor").join(groups, "grp")
    takes = per_end + 2
    stride = 1 + F.pmod(draw(seed, "pair", "anchor", F.lit("stride")), F.greatest(F.lit(1), F.floor((F.col("size") - 1) / takes)))
    steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(takes), F.col("size").cast("int")) - 1))
    asked = homes.withColumn("step", steps).withColumn("row", F.col("start") + F.pmod(draw(seed, "pair", "anchor") + F.col("step") * stride, "size"))
    found = asked.join(members.select("row", "item"), "row").where("item <> a and item <> b")
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("pair", "anchor").orderBy("step")))
    return ranked.where(F.col("k") <= per_end).select("pair", "anchor", F.col("item").alias("partner"))


def substitute_and_control(pairs: DataFrame, vectors: DataFrame, grouping: DataFrame, seed: int = SEED) -> DataFrame:
    """(side, pair, a, b, cosine) of the pairs whose ends both have vectors, and of their random controls."""
    known = vectors.select("item")
    inside = pairs.join(known.withColumnRenamed("item", "a"), "a", "left_semi").join(known.withColumnRenamed("item", "b"), "b", "left_semi")
    near = pair_cosines(inside.select("pair", "a", "b"), vectors).select(F.lit("substitute").alias("side"), "pair", "a", "b", "cosine")
    controls = random_controls(inside, grouping.join(known, "item", "left_semi"), seed)
    far = pair_cosines(controls.select("pair", F.col("anchor").alias("a"), F.col("partner").alias("b")), vectors)
    return near.unionByName(far.select(F.lit("random").alias("side"), "pair", "a", "b", "cosine"))


def lift(cosines: DataFrame) -> DataFrame:
    """(n_substitute, n_random, mean_substitute, mean_random, lift); null means where a side is empty."""
    of = lambda side: F.avg(F.when(F.col("side") == side, F.col("cosine")))
    found = cosines.agg(F.count_if(F.col("side") == "substitute").alias("n_substitute"), F.count_if(F.col("side") == "random").alias("n_random"), of("substitute").alias("mean_substitute"), of("random").alias("mean_random"))
    return found.withColumn("lift", F.col("mean_substitute") - F.col("mean_random"))


#: Values that a task weighs.
PER_TASK = 1 << 14
#: Values that are weighed at once, and weights of them that are drawn at once.
_VALUES, _WEIGHTS = 1 << 11, 1 << 16


def _weighed(replicates: int):
    """Of each side, for every replicate, the sum of the weighted values and of the weights in a task."""

    def add(s: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, values: np.ndarray) -> None:
        # (x r + y) modulo PRIME for some replicates; those of the next ones are one addition away, as numbers below
        # 2^31 have room in 32 bits for a sum of two
        some = min(replicates, max(1, _WEIGHTS // len(values)))
        u = ((x[:, None] * np.arange(some) + y[:, None]) % PRIME).astype(np.uint32)
        step = (x * some % PRIME).astype(np.uint32)[:, None]
        less, over, weights = np.empty_like(u), np.empty(u.shape, bool), np.empty(u.shape, np.int8)
        both = np.stack([values, np.ones(len(values))])
        for first in range(0, replicates, some):
            weights[:] = 0
            top = u.max()
            for cut_at in CUTS:
                if top < cut_at:
                    break
                np.greater_equal(u, np.uint32(cut_at), out=over)
                np.add(weights, over.view(np.int8), out=weights)
            found = both @ weights.astype(np.float64)
            last = min(first + some, replicates)
            s[first:last] += found[0, : last - first]
            n[first:last] += found[1, : last - first].astype(np.int64)
            np.add(u, step, out=u)
            np.subtract(u, np.uint32(PRIME), out=less)  # wraps around below PRIME
            np.minimum(u, less, out=u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sides = np.array(batch.column("side").to_pylist())
            x, y, values = (batch.column(c).to_numpy() for c in ("x", "y", "cosine"))
            for side in set(sides.tolist()):
                s, n = sums.setdefault(side, (np.zeros(replicates), np.zeros(replicates, np.int64)))
                own = np.flatnonzero(sides == side)
                for at in range(0, len(own), _VALUES):
                    some = own[at : at + _VALUES]
                    add(s, n, x[some], y[some], values[some])
        for side, (s, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array([side] * replicates), pa.array(s), pa.array(n)], ["replicate", "side", "s", "n"])

    return run


def bootstrap(cosines: DataFrame, replicates: int = REPLICATES, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """(lift, ci_low, ci_high): both sides (side, pair, a, b, cosine) resampled independently of each other.

    In each replicate a value counts as often as a Poisson variable of mean 1 says, drawn from two
    numbers that md5 gives to (side, pair, a, b): (x r + y) modulo a prime in replicate r. Weights
    of different values are independent, those of a value in two replicates pairwise, and any engine
    repeats them however rows are dealt. Only a sum and a count for each replicate and side leave a
    task. Without values on a side the interval is null; a replicate that has none of a side is
    left out."""
    key = ticket(seed, "side", "pair", "a", "b")
    number = lambda at: F.pmod(F.conv(F.substring(key, at, 8), 16, 10).cast("long"), F.lit(PRIME))
    rows = cosines.where("cosine is not null").select("side", number(1).alias("x"), number(9).alias("y"), "cosine")
    # few bytes, much work: adaptive execution would leave them to a task or two
    rows = rows.repartition(max(1, -(-cosines.count() // PER_TASK)), "x", "y")
    sums = rows.mapInArrow(_weighed(replicates), "replicate long, side string, s double, n long")
    means = sums.groupBy("replicate", "side").agg(F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("m"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("m")))
    lifts = means.groupBy("replicate").agg((of("substitute") - of("random")).alias("lift"))
    ends = lifts.agg(F.percentile("lift", F.lit((1 - level) / 2)).alias("ci_low"), F.percentile("lift", F.lit((1 + level) / 2)).alias("ci_high"))
    return ends.select(lift(cosines).select("lift").scalar().alias("lift"), "ci_low", "ci_high")


def verdict(found: Column, ci_low: Column, mined: Column) -> Column:
    """Null or NaN lift is no data rather than a pass."""
    none = found.isNull() | F.isnan(found) | ci_low.isNull() | F.isnan(ci_low)
    narrow = mined.isNotNull() & (mined > 0) & (found < RATIO * mined)
    return F.when(none, "NO_DATA").when((found < MIN_LIFT) | (ci_low <= 0), "FAIL").when(narrow, "PHENOTYPE_FIT").otherwise("PASS")


def narrow_effect(found: Column, mined: Column) -> Column:
    return F.coalesce((mined < MIN_LIFT) & (mined < RATIO * found), F.lit(False))


def harness(substitute: float | None, random: float | None) -> dict:
    """Whether the means are those of an earlier run; for information."""
    matches = None if substitute is None or random is None else abs(substitute - REFERENCE[0]) <= TOLERANCE and abs(random - REFERENCE[1]) <= TOLERANCE
    return {"observed_substitute": substitute, "observed_random": random, "expected_substitute": REFERENCE[0], "expected_random": REFERENCE[1], "tolerance": TOLERANCE, "matches_reference": matches}
