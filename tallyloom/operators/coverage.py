"""How much of what baskets hold is covered: parsed (item, type_line, status, ...) against baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import quotient
from ..functions.text import is_land
from . import baskets as B

STATUSES = ("clean", "gap", "crash", "excluded")
HEADS = (100, 500, 2000)
MISSING = "not in snapshot"
# Thresholds of the verdict.
PASS, FAIL, GUARD_DROP = 0.85, 0.70, 0.10


def with_status(items: DataFrame, statuses: DataFrame) -> DataFrame:
    """Items with their parse status; an item that has none is excluded as missing."""
    joined = items.dropDuplicates(["item"]).join(statuses, "item", "left")
    missing = F.col("status").isNull()
    filled = joined.withColumn("exclusion_reason", F.when(missing, MISSING).otherwise(F.col("exclusion_reason"))).withColumn("status", F.coalesce("status", F.lit("excluded")))
    return filled.withColumn("ok", F.col("status") == "clean").withColumn("encoded", F.col("status").isin("clean", "gap"))


def weighed(parsed: DataFrame, baskets: DataFrame) -> DataFrame:
    """Parsed items with appearances (0 for none) and whether they are land or a staple."""
    counts = B.appearance_counts(baskets)
    limit = B.basket_count(baskets)
    flagged = counts.withColumn("staple", F.col("appearances") > 0.5 * limit.scalar())
    joined = parsed.join(flagged, "item", "left")
    return joined.select(*parsed.columns, F.coalesce("appearances", F.lit(0)).alias("appearances"), F.coalesce("staple", F.lit(False)).alias("staple"), F.col("staple").isNotNull().alias("seen"), is_land("type_line").alias("land"))


def weighted_coverage(items: DataFrame, flag: str = "ok") -> DataFrame:
    """(covered, total, coverage) of appearances."""
    return items.agg(*_weights(F.lit(True), flag)).select("covered", "total", quotient(F.col("covered"), F.col("total")).alias("coverage"))


def _weights(subset: Column, flag: str = "ok") -> list[Column]:
    covered = F.coalesce(F.sum(F.when(subset & F.col(flag), F.col("appearances"))), F.lit(0)).alias("covered")
    return [covered, F.coalesce(F.sum(F.when(subset, F.col("appearances"))), F.lit(0)).alias("total")]


def strata(items: DataFrame) -> DataFrame:
    """(stratum, covered, total, coverage) of all items and of those that are not land, not staples,
    or neither; one pass, as the strata overlap."""
    subsets = {"all": F.lit(True), "non_land": ~F.col("land"), "non_staple": ~F.col("staple"), "non_land_non_staple": ~F.col("land") & ~F.col("staple")}
    sums = items.agg(*[F.struct(*_weights(s)).alias(k) for k, s in subsets.items()])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), F.col(f"{k}.covered"), F.col(f"{k}.total")) for k in subsets])).alias("r")).select("r.*")
    return rows.withColumn("coverage", quotient(F.col("covered"), F.col("total")))


def unmatched(parsed: DataFrame, baskets: DataFrame) -> DataFrame:
    """(items, appearances) in baskets that were never parsed, which strata leave out."""
    lost = B.appearance_counts(baskets).join(parsed.select("item"), "item", "left_anti")
    return lost.agg(F.count("*").alias("items"), F.coalesce(F.sum("appearances"), F.lit(0)).alias("appearances"))


def head_breakouts(items: DataFrame, baskets: DataFrame, heads: tuple[int, ...] = HEADS) -> DataFrame:
    """(head, appearance_coverage, distinct_coverage, n_items) of the most frequent items, ties by id.

    Only the largest head is ranked, after a top-n."""
    top = B.appearance_counts(baskets).orderBy(F.desc("appearances"), "item").limit(max(heads))
    ranked = top.select("item", F.row_number().over(Window.orderBy(F.desc("appearances"), "item")).alias("place"))
    joined = items.join(F.broadcast(ranked), "item").withColumn("head", F.explode(F.array(*[F.lit(h) for h in heads]))).where("place <= head")
    found = joined.groupBy("head").agg(F.sum(F.when(F.col("ok"), F.col("appearances"))).alias("c"), F.sum("appearances").alias("t"), F.avg(F.col("ok").cast("int")).alias("distinct_coverage"), F.count("*").alias("n_items"))
    return found.select("head", quotient(F.coalesce("c", F.lit(0)), F.col("t")).alias("appearance_coverage"), "distinct_coverage", "n_items")


def status_share(items: DataFrame) -> DataFrame:
    """(status, appearances, share, n_items) of all four statuses; n_items counts items in baskets."""
    spark = items.sparkSession
    found = items.groupBy("status").agg(F.sum("appearances").alias("a"), F.sum(F.col("seen").cast("int")).alias("n"))
    rows = spark.createDataFrame([(s,) for s in STATUSES], "status string").join(F.broadcast(found), "status", "left")
    total = F.sum(F.coalesce("a", F.lit(0))).over(Window.partitionBy())
    return rows.select("status", F.coalesce("a", F.lit(0)).alias("appearances"), quotient(F.coalesce("a", F.lit(0)), total).alias("share"), F.coalesce("n", F.lit(0)).alias("n_items"))


def exclusion_reasons(items: DataFrame) -> DataFrame:
    rows = items.where("status = 'excluded' and exclusion_reason is not null")
    return rows.groupBy("exclusion_reason").agg(F.sum("appearances").alias("appearances")).orderBy(F.desc("appearances"), "exclusion_reason")


def gap_categories(items: DataFrame, n: int = 12) -> DataFrame:
    rows = items.where("status = 'gap' and gap_category is not null")
    return rows.groupBy("gap_category").agg(F.sum("appearances").alias("appearances")).orderBy(F.desc("appearances"), "gap_category").limit(n)


def failures(items: DataFrame, n: int = 200) -> DataFrame:
    """The most frequent items that aren't clean."""
    return items.where(~F.col("ok")).orderBy(F.desc("appearances"), "item").limit(n)


def distinct_coverage(items: DataFrame) -> DataFrame:
    """(all_items, in_baskets): share of clean items."""
    ok = F.col("ok").cast("int")
    return items.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("all_items"), F.coalesce(F.avg(F.when(F.col("seen"), ok)), F.lit(0.0)).alias("in_baskets"))


def verdict(coverage: Column, guarded: Column) -> Column:
    """The guard can turn a pass into unresolved, never rescue a failure."""
    return F.when(coverage < FAIL, "FAIL").when((coverage >= PASS) & (coverage - guarded <= GUARD_DROP), "PASS").otherwise("UNRESOLVED")


def judged(items: DataFrame) -> DataFrame:
    """(coverage, guarded, verdict) in one row."""
    found = strata(items).groupBy().pivot("stratum", ["all", "non_land_non_staple"]).agg(F.first("coverage"))
    return found.select(F.col("all").alias("coverage"), F.col("non_land_non_staple").alias("guarded"), verdict(F.col("all"), F.col("non_land_non_staple")).alias("verdict"))
