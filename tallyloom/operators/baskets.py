"""Baskets of items: (basket, item) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import SEED, border, ticket
from ..functions.lineage import cut
from ..functions.order import running


def distinct_items(baskets: DataFrame) -> DataFrame:
    return baskets.select("basket", "item").where("item is not null").distinct()


def appearance_counts(baskets: DataFrame) -> DataFrame:
    """(item, appearances): in how many baskets an item is, once for each basket."""
    return distinct_items(baskets).groupBy("item").agg(F.count("*").alias("appearances"))


def basket_count(baskets: DataFrame) -> DataFrame:
    return baskets.agg(F.countDistinct("basket").alias("n"))


def staples(baskets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Items in more than `threshold` of all baskets."""
    total = basket_count(baskets)
    return appearance_counts(baskets).where(F.col("appearances") > threshold * total.scalar())


def split_baskets(baskets: DataFrame, test_share: float = 0.15, seed: int = SEED) -> DataFrame:
    """(basket, split): whole baskets go to `test`, a rounded share and one at least, or `train`.

    The test set is the first tickets of a seeded order, so a basket's side needs no global rank:
    only the ticket at the border is looked up, by histograms."""
    ids = cut(baskets.select("basket").distinct().withColumn("_ticket", ticket(seed, "basket")))
    last = border(ids, lambda total: max(1, round(total * test_share)))
    inside = F.lit(True) if last is None else F.col("_ticket") <= last[0]
    return ids.select("basket", F.when(inside, "test").otherwise("train").alias("split"))


def temporal_split(dated: DataFrame, test_share: float = 0.15) -> DataFrame:
    """(basket, created_at, split, cutoff) of dated baskets: `test` from the date of the n-th latest
    on, so ties at the cutoff enlarge it. Baskets without a date go. `created_at` is an ISO string."""
    rows = dated.where("created_at is not null and created_at <> ''").select("basket", "created_at").distinct()
    per_date = rows.groupBy("created_at").agg(F.count("*").alias("n"))
    total = rows.count()
    n = max(1, round(total * test_share))
    # dates, not baskets, are ranked, and by ranges
    earlier = running(per_date, ["created_at"], {"earlier": "n"})
    cutoff = earlier.where(F.lit(total) - F.col("earlier") >= n).agg(F.max("created_at").alias("cutoff"))
    return rows.select("basket", "created_at", cutoff.scalar().alias("cutoff")).withColumn("split", F.when(F.col("created_at") < F.col("cutoff"), "train").otherwise("test"))


def assert_no_leak(train: DataFrame, test: DataFrame) -> None:
    """Raise if a basket is on both sides."""
    both = train.select("basket").distinct().join(test.select("basket").distinct(), "basket", "left_semi")
    shown = [r["basket"] for r in both.orderBy("basket").limit(5).collect()]
    if shown:
        raise AssertionError(f"{both.count()} baskets are in both train and test, such as {shown}")
