"""Names to items, in two tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACES = " // "


def name_lookup(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, item) by whole lower-case name, the last by ordinal, and by front face, the first."""
    rows = items.select("item", "ordinal", F.lower("name").alias("key")).where("key is not null and key <> ''")
    exact = rows.groupBy("key").agg(F.max_by("item", "ordinal").alias("item"))
    faces = rows.where(F.contains("key", F.lit(FACES))).withColumn("key", F.split_part("key", F.lit(FACES), F.lit(1)))
    return exact, faces.groupBy("key").agg(F.min_by("item", "ordinal").alias("item"))


def resolve(names: DataFrame, items: DataFrame) -> DataFrame:
    """Adds `item` and `tier` (exact, front or unresolved) to rows with a `name`: its whole name, else
    a front face by that name, else by its own front."""
    exact, front = name_lookup(items)
    keyed = names.withColumn("_key", F.lower("name")).withColumn("_front", F.split_part("_key", F.lit(FACES), F.lit(1)))
    joined = (
        keyed.join(exact.select(F.col("key").alias("_key"), F.col("item").alias("_e")), "_key", "left")
        .join(front.select(F.col("key").alias("_key"), F.col("item").alias("_f")), "_key", "left")
        .join(front.select(F.col("key").alias("_front"), F.col("item").alias("_g")), "_front", "left")
    )
    tier = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_f").isNotNull() | F.col("_g").isNotNull(), "front").otherwise("unresolved")
    return joined.select(*names.columns, F.coalesce("_e", "_f", "_g").alias("item"), tier.alias("tier"))


def resolution_stats(resolved: DataFrame, examples: int = 50) -> DataFrame:
    """One row: baskets, baskets with an item, names by tier, rate, and unresolved examples."""
    of = lambda t: F.count_if(F.col("tier") == t)
    counts = resolved.agg(
        F.countDistinct("basket").alias("n_baskets"),
        F.countDistinct(F.when(F.col("tier") != "unresolved", F.col("basket"))).alias("n_baskets_resolved"),
        F.count("*").alias("n_names"), of("exact").alias("n_exact"), of("front").alias("n_front"), of("unresolved").alias("n_unresolved"),
    )
    shown = resolved.where("tier = 'unresolved'").select("name").distinct().orderBy("name").limit(examples).agg(F.concat_ws("|", F.array_sort(F.collect_list("name"))).alias("e"))
    rate = F.coalesce(F.try_divide((F.col("n_exact") + F.col("n_front")).cast("double"), F.col("n_names").cast("double")), F.lit(0.0))
    return counts.select("*", rate.alias("resolution_rate"), shown.scalar().alias("unresolved_examples"))
