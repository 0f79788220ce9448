"""Pairs of items mined from their texts and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_masked, number_template, primary_type, squeezed, stripped, text

PER_TEMPLATE, IDENTICAL, CANDIDATES = 3, 800, 400
# Tag prefixes that group by identity, and sizes of tags that are kept.
TAG_PREFIXES = ("typal-", "type-errata-", "art-", "artist-", "cycle-", "flavor-", "french-vanilla", "vanilla", "reprint", "banned", "restricted", "format-", "set-")
TAG_SIZES = (2, 40)


def _worded(items: DataFrame) -> DataFrame:
    """Items with a text, once each: of repeated items the least name and text."""
    rows = items.where(stripped("text") != "").groupBy("item").agg(F.min(F.struct("name", "text")).alias("r"))
    return rows.select("item", "r.name", "r.text")


def numeric_pairs(items: DataFrame, most: int = PER_TEMPLATE) -> DataFrame:
    """(a, b, template): items (item, name, text) whose texts differ in numbers only, the first
    `most` pairs of each template in name order.

    A template's first `most` items are enough on the left: if one of them has no partner, all
    texts are equal, and otherwise each adds one. So a common template costs its size, not its
    square."""
    rows = _worded(items).withColumn("template", number_template("text")).where(F.col("text").rlike("[0-9]") & (F.length("template") > 12))
    rows = rows.withColumn("place", F.struct(F.coalesce("name", F.lit("")).alias("name"), "item")).withColumn("body", stripped("text"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("template").orderBy("place"))).where(F.col("k") <= most)
    left = first.select("template", F.col("item").alias("a"), F.col("place").alias("pa"), F.col("body").alias("ba"))
    right = rows.select("template", F.col("item").alias("b"), F.col("place").alias("pb"), F.col("body").alias("bb"))
    pairs = left.join(right, "template").where("pa < pb and ba <> bb")
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("template").orderBy("pa", "pb"))).where(F.col("k") <= most)
    return ranked.select("a", "b", F.substring("template", 1, 120).alias("template"))


def identical_text_pairs(items: DataFrame, most: int = IDENTICAL) -> DataFrame:
    """(a, b, note): neighbours in name order among items with one text, own names masked; the first
    `most` in order of text and name. So many pairs lie among the first 2 `most` + 2 of the items whose text
    is not alone: only these are ranked, however many items share a text."""
    rows = _worded(items).withColumn("masked", name_masked("text", "name")).where(F.length("masked") > 20)
    several = rows.groupBy(F.sha2("masked", 256).alias("_text")).agg(F.count("*").alias("_n")).where("_n > 1").select("_text")
    rows = rows.join(several, F.sha2("masked", 256) == F.col("_text"), "left_semi").orderBy("masked", "name", "item").limit(2 * most + 2)
    following = Window.partitionBy("masked").orderBy("name", "item")
    pairs = rows.select("masked", "name", F.col("item").alias("a"), F.lead("item").over(following).alias("b")).where("b is not null")
    return pairs.orderBy("masked", "name", "a").limit(most).select("a", "b", F.substring("masked", 1, 100).alias("note"))


def tag_index(taggings: DataFrame) -> DataFrame:
    """(slug, item): tags that say what items do, of usable size."""
    named = taggings.where(text("slug") != "")
    for prefix in TAG_PREFIXES:
        named = named.where(~F.startswith("slug", F.lit(prefix)))
    rows = named.where("item is not null").select("slug", "item").distinct()
    sizes = rows.groupBy("slug").agg(F.count("*").alias("n")).where(F.col("n").between(*TAG_SIZES)).select("slug")
    return rows.join(sizes, "slug", "left_semi")


def tag_candidates(items: DataFrame, taggings: DataFrame, apart: float = 1.0, most: int = CANDIDATES) -> DataFrame:
    """(a, b, slug, n): items that share a tag and a primary type and cost about the same, by the
    number of present members of their smallest shared tag (then by slug)."""
    info = items.dropDuplicates(["item"]).select("item", primary_type("type_line").alias("kind"), F.coalesce("cost", F.lit(0)).cast("double").alias("cost"))
    present = taggings.join(info, "item")
    sizes = present.groupBy("slug").agg(F.count("*").alias("n"))
    left = present.select("slug", "kind", F.col("item").alias("a"), F.col("cost").alias("ca"))
    right = present.select("slug", "kind", F.col("item").alias("b"), F.col("cost").alias("cb"))
    shared = left.join(right, ["slug", "kind"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ca") - F.col("cb")) <= apart)).join(sizes, "slug")
    best = shared.groupBy("a", "b").agg(F.min(F.struct("n", "slug")).alias("s"))
    return best.select("a", "b", "s.slug", "s.n").orderBy("n", "slug", "a", "b").limit(most)


def reprint_pairs(printings: DataFrame) -> DataFrame:
    """(item, text_a, text_b, wordings) for items printed with two wordings or more: each wording
    against the next, so that texts are compared and not an item with itself."""
    rows = printings.where("item is not null").select("item", squeezed("printed_text").alias("text")).where("text <> ''").distinct()
    after = Window.partitionBy("item").orderBy("text")
    numbered = rows.select("item", F.col("text").alias("text_a"), F.lead("text").over(after).alias("text_b"), F.count("*").over(Window.partitionBy("item")).alias("wordings"))
    return numbered.where("text_b is not null")


def curated_pairs(named: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, role), names that no item has). Names match exactly; of items with one name the
    last by ordinal counts."""
    known = items.groupBy("name").agg(F.max_by("item", "ordinal").alias("item"))
    rows = named.select(stripped("name_a").alias("name_a"), stripped("name_b").alias("name_b"), "role")
    left, right = known.select(F.col("name").alias("name_a"), F.col("item").alias("a")), known.select(F.col("name").alias("name_b"), F.col("item").alias("b"))
    joined = rows.join(left, "name_a", "left").join(right, "name_b", "left")
    lost = joined.where("a is null").select(F.col("name_a").alias("name")).union(joined.where("b is null").select("name_b"))
    return joined.where("a is not null and b is not null").select("a", "b", "role"), lost


def checked_pairs(named: DataFrame, items: DataFrame, identical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(curated pairs whose names exist and whose texts differ, those whose texts were found
    identical). `identical` is (a, b) of items."""
    pairs, _ = curated_pairs(named, items)
    same = identical.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).distinct()
    keyed = pairs.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    return keyed.join(same, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi"), keyed.join(same, ["_lo", "_hi"], "left_semi").drop("_lo", "_hi")
