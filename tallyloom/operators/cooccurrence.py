"""Co-occurrence of items in baskets, PPMI, and pairs mined from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import SEED, border, draw, sample, ticket
from ..functions.lineage import cut, shuffled_into, tasks_for
from ..functions.order import running
from ..functions.vectors import pair_cosines

TOP = 0.10
ANCHORS, CELLS, PHENOTYPES = 4000, 20_000, 300
#: Items of a basket, or of a chunk of one, that meet in one task.
TILE = 2048
#: Size of the sketches that bracket ranks, and by how much of all values a rank may be off in them.
SKETCH, MARGIN = 4096, 0.004


def _large_pairs(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b) of baskets of more than TILE items: an item lies in one of a basket's chunks, and goes to each pair of
    chunks that its own is in. A pair of chunks is a key, so no key holds more than two chunks."""
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    dealt = items.join(sizes, "basket").select("basket", "item", chunks.alias("chunks"), F.pmod(F.xxhash64("item"), chunks).cast("int").alias("chunk"))
    asked = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    side = lambda chunk, name: asked.where(F.col("chunk") == F.col(chunk)).select("basket", "low", "high", F.col("item").alias(name))
    met = side("low", "x").join(side("high", "y"), ["basket", "low", "high"]).where("x < y or (low < high and x > y)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cooccurrence(baskets: DataFrame) -> DataFrame:
    """(a, b, n) for a < b: how many baskets hold both. They are stored.

    One shuffle by basket serves both sides of the self join; a basket of more than TILE items is dealt into
    pairs of chunks first, so none costs a task its square. Pairs are counted before they are shuffled.
    The cost is the sum of squared basket sizes, halved; there are as many tasks as the pairs need, so what one
    holds doesn't grow. Rows are dealt by basket before they are made distinct or counted: a task that reads a part of a
    file holds no table of its rows, however large the part is."""
    spark, rows = baskets.sparkSession, baskets.where("item is not null").select("basket", "item")
    # rows, repeats included, bound a basket's items from above, and need no distinct
    sizes = rows.select("basket").repartition(tasks_for(rows.count()), "basket").groupBy("basket").agg(F.count("*").alias("size"))
    large, size = sizes.where(F.col("size") > TILE), F.col("size").cast("double")
    most, cells = sizes.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum(size * (size + 1) / 2), F.lit(0.0))).first()
    joined = lambda own: own.withColumnRenamed("item", "a").join(own.withColumnRenamed("item", "b"), "basket").where("a < b").select("a", "b")
    with shuffled_into(spark, tasks_for(int(cells))):
        items = rows.repartition(tasks_for(int(cells)), "basket").distinct()
        if most <= TILE:
            pairs = joined(items)
        else:
            items, large = cut(items), cut(large)
            pairs = joined(items.join(large, "basket", "left_anti")).unionByName(_large_pairs(items, large))
        return cut(pairs.groupBy("a", "b").agg(F.count("*").alias("n")))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(a, b, n, ppmi) of pairs with a positive value: ln(n T / (r(a) r(b))) where T sums all ordered
    cells and r an item's. Raises if nothing co-occurs. `pairs` are used several times, so they should be
    stored, as `cooccurrence` does; the values are stored."""
    cells, counted = pairs.agg(F.count("*"), F.sum("n")).first()
    if not cells:
        raise ValueError("no items co-occur")
    marginals = pairs.select(F.explode(F.array("a", "b")).alias("item"), "n").groupBy("item").agg(F.sum("n").alias("r"))
    ra, rb = marginals.select(F.col("item").alias("a"), F.col("r").alias("ra")), marginals.select(F.col("item").alias("b"), F.col("r").alias("rb"))
    value = F.log(F.col("n").cast("double") * F.lit(float(2 * counted))) - F.log(F.col("ra").cast("double")) - F.log(F.col("rb").cast("double"))
    with shuffled_into(pairs.sparkSession, tasks_for(cells)):
        return cut(pairs.join(ra, "a").join(rb, "b").select("a", "b", "n", value.alias("ppmi")).where("ppmi > 0"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both triangles."""
    return pairs.unionByName(pairs.withColumnsRenamed({"a": "b", "b": "a"}))


def order_statistics(rows: DataFrame, column: str, ranks: list[int], few: int = 20_000, size: int = SKETCH, margin: float = MARGIN) -> list[float]:
    """The values that so many smaller or equal ones come before (ranks from 0), exactly and in bounded memory. Null and
    NaN aren't values; raises IndexError for a rank that there isn't.

    A mergeable sketch of the values brackets each rank, and one scan counts what lies below the bracket and in it;
    all ranks share both. Brackets of at most `few` values are gathered, larger ones are bracketed again, so
    twelve million values take two scans and a look at the bracket. A sketch that misses makes the next bracket wider."""
    value = F.col(column).cast("double")
    values = rows.select(value.alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if any(not 0 <= r < n for r in ranks):
        raise IndexError(f"ranks {ranks} of {n} values")
    # of each rank: ends of a closed bracket, values below it, values in it, share to allow for
    state, found = {r: (low, high, 0, n, margin) for r in ranks}, {}
    while state:
        for r, (low, high, below, inside, _) in list(state.items()):
            if low == high:
                found[r] = low
            elif inside <= few:
                found[r] = sorted(x["v"] for x in values.where(F.col("v").between(low, high)).collect())[r - below]
        state = {r: s for r, s in state.items() if r not in found}
        if not state:
            break
        asked = []
        for k, (r, (low, high, below, inside, off)) in enumerate(state.items()):
            sketch = F.kll_sketch_agg_double(F.when(F.col("v").between(low, high), F.col("v")), F.lit(size))
            shares = [min(1.0, max(0.0, (r - below) / inside + way * off)) for way in (-1, 1)]
            asked += [F.kll_sketch_get_quantile_double(sketch, F.lit(share)).alias(f"{name}{k}") for share, name in zip(shares, ("low", "high"), strict=True)]
        ends = values.agg(*asked).first()
        v, wanted = F.col("v"), []
        for k in range(len(state)):
            least, most = ends[f"low{k}"], ends[f"high{k}"]
            parts = {"below": v < least, "lowest": v == least, "inside": v.between(least, most), "highest": v == most}
            wanted += [F.count_if(c).alias(f"{name}{k}") for name, c in parts.items()]
        counts = values.agg(*wanted).first()
        for k, (r, (low, high, below, inside, off)) in enumerate(list(state.items())):
            under, lowest, own, highest = (counts[f"{name}{k}"] for name in ("below", "lowest", "inside", "highest"))
            if not under <= r < under + own:
                state[r] = (low, high, below, inside, 4 * off)
            elif r < under + lowest:  # ends that very many values share decide by themselves
                found[r] = ends[f"low{k}"]
            elif r >= under + own - highest:
                found[r] = ends[f"high{k}"]
            else:
                state[r] = (ends[f"low{k}"], ends[f"high{k}"], under, own, margin if own < inside else 0.5 * off)
        state = {r: s for r, s in state.items() if r not in found}
    return [found[r] for r in ranks]


def percentile(rows: DataFrame, column: str, share: float, frequency: int = 1) -> float | None:
    """Linear interpolation between order statistics, each row counting `frequency` times; null and NaN aren't
    values, and without values there is none."""
    n = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return None
    place = (n * frequency - 1) * share
    below = int(place)
    above = min(below + 1, n * frequency - 1)
    ranks = sorted({below // frequency, above // frequency})
    values = order_statistics(rows, column, ranks)
    return values[0] + (values[-1] - values[0]) * (place - below)


def unordered(a: str = "a", b: str = "b") -> list[Column]:
    return [F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")]


def exclusions(eval_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the evaluation pairs, unordered; the items they touch)."""
    return eval_pairs.select(*unordered()).distinct(), eval_pairs.select(F.explode(F.array("a", "b")).alias("_item")).distinct()


def without_pairs(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    keyed = pairs.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    return keyed.join(excluded, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def without_items(pairs: DataFrame, touched: DataFrame) -> DataFrame:
    """Two anti joins: one with OR would compare all rows with all."""
    once = pairs.join(touched.withColumnRenamed("_item", "a"), "a", "left_anti")
    return once.join(touched.withColumnRenamed("_item", "b"), "b", "left_anti")


def strict_ones(pairs: DataFrame, eval_pairs: DataFrame) -> DataFrame:
    """Of mined pairs those that touch no evaluation item: the strict variant of positives, hard negatives
    and phenotype pairs alike."""
    return without_items(pairs, exclusions(eval_pairs)[1])


def mined(values: DataFrame, eval_pairs: DataFrame, top: float = TOP) -> DataFrame:
    """Pairs at or above the percentile of all cells of `values`, which should be stored, but for evaluation pairs."""
    limit = percentile(values, "ppmi", 1 - top, frequency=2)
    if limit is None:
        return values.limit(0)
    return without_pairs(values.where(F.col("ppmi") >= F.lit(limit)), exclusions(eval_pairs)[0])


def positives(values: DataFrame, eval_pairs: DataFrame, top: float = TOP, strict: bool = False) -> DataFrame:
    """What `mined` finds; `strict` also leaves out pairs that touch an evaluation item."""
    found = mined(values, eval_pairs, top)
    return strict_ones(found, eval_pairs) if strict else found


def cap(pairs: DataFrame, most: int | None, seed: int = SEED) -> DataFrame:
    """A random subset of `most` pairs, not a prefix."""
    return sample(cut(pairs), most, ["a", "b"], seed) if most else pairs


def holdout(pairs: DataFrame, share: float = 0.15, seed: int = SEED) -> DataFrame:
    """Adds `split`: a truncated share of the pairs, one at least, is `holdout`."""
    keyed = cut(pairs.withColumn("_ticket", ticket(seed, "a", "b")))
    last = border(keyed, lambda total: max(1, int(share * total)))
    inside = F.lit(True) if last is None else F.col("_ticket") <= last[0]
    return keyed.withColumn("split", F.when(inside, "holdout").otherwise("train")).drop("_ticket")


#: Places that one of Spark's bitmaps holds.
BITS = 8 * 4096


def _first_free(taken: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, free): the least number from 0 that is none of the `place`s of a key; repeats are allowed.

    A bitmap of BITS places is made before anything is shuffled; the first that isn't full, or that is
    missing, says which place is free."""
    bits = taken.groupBy(*keys, F.floor(F.col("place") / BITS).alias("part")).agg(F.bitmap_construct_agg((F.col("place") % BITS).cast("long")).alias("bits"))
    ordered = Window.partitionBy(*keys).orderBy("part")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = (F.bitmap_count("bits") == BITS) & (F.col("part") == F.row_number().over(ordered) - 1)
    full = bits.withColumn("whole", whole).withColumn("full", F.min("whole").over(upto))
    other = F.when(~F.col("full"), F.col("part"))
    prefix = full.groupBy(*keys).agg(F.count_if("full").alias("parts"), F.min_by("bits", other).alias("bits"), F.min(other).alias("part"))
    # of the first byte that isn't full the ones below its least zero
    written = F.hex("bits")
    bytes_full = (F.length(F.regexp_extract(written, "^(?:FF)*", 0)) / 2).cast("int")
    byte = F.conv(F.substr(written, 2 * bytes_full + 1, F.lit(2)), 16, 10).cast("int")
    inside = 8 * bytes_full + F.bit_count(F.shiftright(byte.bitwiseXOR(byte + 1), 1))
    return prefix.select(*keys, (F.col("parts") * BITS + F.when(F.col("part") == F.col("parts"), inside).otherwise(0)).alias("free"))


def hard_negatives(values: DataFrame, colours: DataFrame, vocabulary: DataFrame, eval_pairs: DataFrame, found: DataFrame, anchors: int = ANCHORS, seed: int = SEED, zero: str = "ppmi") -> DataFrame:
    """(a, b): for each drawn anchor a one partner that shares a colour, has no PPMI with it, and
    is neither a positive nor an evaluation pair. `zero` = "count" wants no common basket at all; then
    `values` are the counts. Of a pair that two anchors draw the earlier one's stays.

    The items of all colours lie in random order once. An anchor looks at its colours' items from a
    random place on and takes the first that is free (of equal places, the least colour). What is barred for
    an anchor is looked up by its pairs and kept as bitmaps of places, whose first zero is the
    place: so an anchor costs its pairs, however large its colours are, and there is one pass for all."""
    pairs, _ = exclusions(eval_pairs)
    drawn = cut(sample(vocabulary.select("item"), anchors, ["item"], seed).select(F.col("item").alias("a")))
    if zero not in ("ppmi", "count"):
        raise ValueError(f"zero is ppmi or count, not {zero!r}")
    of = colours.join(vocabulary.select("item"), "item", "left_semi").select("item", F.explode("colours").alias("colour")).distinct()
    members = running(of.withColumn("_ticket", ticket(seed, "colour", "item")), ["colour", "_ticket", "item"], {}).select("colour", "row", F.col("item").alias("b"))
    members = cut(members)
    sizes = members.groupBy("colour").agg(F.count("*").alias("size"), F.min("row").alias("start"))
    asked = cut(members.join(drawn, F.col("b") == F.col("a")).select("a", "colour").join(sizes, "colour").withColumn("first", F.pmod(draw(seed, "a", "colour"), "size")))
    barred = values.select("a", "b").unionByName(found.select("a", "b")).unionByName(pairs.select(F.col("_lo").alias("a"), F.col("_hi").alias("b")))
    both = barred.unionByName(barred.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = both.join(drawn, "a", "left_semi").unionByName(drawn.select("a", F.col("a").alias("b")))
    taken = own.join(members, "b").join(asked, ["a", "colour"]).select("a", "colour", F.pmod(F.col("row") - F.col("start") - F.col("first"), "size").alias("place"))
    free = _first_free(taken, ["a", "colour"]).join(asked, ["a", "colour"]).where("free < size")
    chosen = free.groupBy("a").agg(F.min(F.struct("free", "colour", (F.col("start") + F.pmod(F.col("first") + F.col("free"), "size")).alias("row"))).alias("p")).select("a", "p.row")
    keyed = chosen.join(members.select("row", "b"), "row").select(*unordered(), F.struct(ticket(seed, "a").alias("t"), "a", "b").alias("c"))
    return keyed.groupBy("_lo", "_hi").agg(F.min("c").alias("c")).select("c.a", "c.b")


def phenotype_pairs(values: DataFrame, vectors: DataFrame, eval_pairs: DataFrame, n: int = PHENOTYPES, cells: int = CELLS, seed: int = SEED) -> DataFrame:
    """(kind, a, b, ppmi, cosine): of sampled cells the `positive` ones of high PPMI, then low cosine,
    and the `negative` ones of low PPMI, then high cosine."""
    pairs, _ = exclusions(eval_pairs)
    drawn = sample(values.select("a", "b", "ppmi"), cells, ["a", "b"], seed)
    scored = pair_cosines(without_pairs(drawn, pairs), vectors).select("a", "b", F.round("ppmi", 6).alias("ppmi"), F.round("cosine", 6).alias("cosine"))
    high = scored.orderBy(F.desc("ppmi"), "cosine", "a", "b").limit(n).withColumn("kind", F.lit("positive"))
    low = scored.orderBy("ppmi", F.desc("cosine"), "a", "b").limit(n).withColumn("kind", F.lit("negative"))
    return high.unionByName(low)
