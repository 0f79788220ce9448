"""Readers of items, baskets, tags, printings and curated pairs. Each carries an ordinal where an order
of rows decides: (file, block, row), which no partitioning changes."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.lineage import cut
from ..functions.text import text
from ..operators import names
from ..operators.pairs import TAG_PREFIXES, curated_pairs, tag_index

ITEM = "oracle_id string, name string, oracle_text string, type_line string, cmc double, color_identity array<string>"
CASUAL = "deck_id string, commander string, card_names array<string>, created_at string"
#: Fixed value: the source that tournament baskets carry.
TOURNAMENT = "edhtop16"
#: Rows, for each basket that is still wanted, that are looked at in file order at a time.
AHEAD = 128


def _ordinal() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped or not, with `ordinal`; lines that aren't JSON objects go."""
    lines = spark.read.text(path).select("value", _ordinal().alias("ordinal"))
    parsed = lines.select(F.from_json("value", schema).alias("r"), "ordinal")
    return parsed.where("r is not null").select("r.*", "ordinal")


def item_snapshot(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """One row for each id, the last line's; lines without id go."""
    rows = json_lines(spark, path, schema).where(text("oracle_id") != "")
    last = rows.groupBy("oracle_id").agg(F.max_by(F.struct(*rows.columns), "ordinal").alias("r"))
    return last.select("r.*").withColumnRenamed("oracle_id", "item")


def items_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def named_baskets(spark: SparkSession, path: str, items: DataFrame, limit: int | None = None, prefix: str = "archidekt:") -> tuple[DataFrame, DataFrame]:
    """(baskets (basket, commander, created_at, item), resolved names with tiers) of baskets that list
    names. Baskets without names, or none of whose names resolves, go; `limit` counts kept ones in
    file order."""
    rows = json_lines(spark, path, CASUAL).where(F.size(F.coalesce("card_names", F.array().cast("array<string>"))) > 0)
    listed = rows.select(F.concat(F.lit(prefix), "deck_id").alias("basket"), text("commander").alias("commander"), "created_at", "ordinal", F.posexplode("card_names").alias("at", "name"))
    resolved = names.resolve(listed, items)
    if limit is not None:
        kept = resolved.where("item is not null").groupBy("basket").agg(F.min("ordinal").alias("o")).orderBy("o").limit(limit)
        border = kept.agg(F.max("o").alias("o"))
        resolved = resolved.where(F.col("ordinal") <= border.scalar())
    return resolved.where("item is not null").select("basket", "commander", "created_at", "item").distinct(), resolved


def _from_pairs(rows: DataFrame, prefix: str) -> DataFrame:
    """Valid rows of (deck_id, oracle_id, commander_name, temporally_valid) as (basket, commander, item);
    a null flag isn't valid, and the commander is the first that is named."""
    valid = rows.where(F.coalesce("temporally_valid", F.lit(False))) if "temporally_valid" in rows.columns else rows
    first = valid.where("commander_name is not null").groupBy("deck_id").agg(F.min_by("commander_name", "ordinal").alias("commander"))
    pairs = valid.where("oracle_id is not null").select("deck_id", F.col("oracle_id").cast("string").alias("item")).distinct()
    return pairs.join(first, "deck_id", "left").select(F.concat(F.lit(prefix), F.col("deck_id").cast("string")).alias("basket"), text("commander").alias("commander"), "item")


def _first_baskets(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` baskets in file order, before rows are judged valid.

    The first rows of baskets that aren't known yet name the next ones, until there are enough: a task holds the
    first rows only, no rows are sorted or moved, and each look finds one basket at least."""
    if limit is None:
        return rows
    kept, found = None, 0
    while found < limit:
        wanted = limit - found
        rest = rows if kept is None else rows.join(F.broadcast(kept.select(F.col("deck_id").alias("_known"))), F.col("deck_id").eqNullSafe(F.col("_known")), "left_anti")
        first = rest.select("deck_id", "ordinal").orderBy("ordinal").limit(AHEAD * wanted)
        more = cut(first.groupBy("deck_id").agg(F.min("ordinal").alias("o")).orderBy("o").limit(wanted).select("deck_id"))
        n = more.count()
        kept, found = more if kept is None else cut(kept.union(more)), found + n
        if not n:
            break
    return rows.limit(0) if kept is None else rows.join(F.broadcast(kept), "deck_id", "left_semi")


def tournament_baskets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("source") == TOURNAMENT).select("deck_id", "oracle_id", "commander_name", "temporally_valid", _ordinal().alias("ordinal"))
    return _from_pairs(_first_baskets(rows, limit), "edhtop16:")


def fixed_baskets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path).select("deck_id", "oracle_id", "commander_name", "temporally_valid", _ordinal().alias("ordinal"))
    return _from_pairs(_first_baskets(rows, limit), "precon:")


def corpus(name: str) -> Callable[..., DataFrame]:
    """The reader of a kind of corpus."""
    readers = {"casual": named_baskets, "cedh": tournament_baskets, "precon": fixed_baskets}
    if name not in readers:
        raise ValueError(f"unknown corpus {name!r}; one of {', '.join(readers)}")
    return readers[name]


@pandas_udf(T.ArrayType(T.StringType()))
def _literal_ids(values: pd.Series) -> pd.Series:
    """Item ids of taggings that are written as a Python literal; null if they don't parse."""

    def ids(value):
        try:
            return [t["oracle_id"] for t in ast.literal_eval(value) or [] if t.get("oracle_id")]
        except (ValueError, SyntaxError, TypeError, AttributeError, KeyError):
            return None

    return values.map(ids, na_action="ignore")


def tags(spark: SparkSession, path: str) -> DataFrame:
    """(slug, item) of usable tags. Taggings are an array or a Python literal of one; of a repeated
    slug the last line of usable size counts."""
    lines = spark.read.text(path).select("value", _ordinal().alias("ordinal"))
    raw = lines.select(F.get_json_object("value", "$.slug").alias("slug"), F.get_json_object("value", "$.taggings").alias("t"), "ordinal")
    for prefix in TAG_PREFIXES:
        raw = raw.where(~F.startswith("slug", F.lit(prefix)))
    as_json = F.transform(F.from_json("t", "array<struct<oracle_id: string>>"), lambda x: x["oracle_id"])
    literal = F.when(F.col("t").contains("'"), F.col("t"))
    ids = F.array_distinct(F.filter(F.coalesce(as_json, _literal_ids(literal)), lambda x: x.isNotNull() & (x != "")))
    usable = raw.where("slug <> ''").select("slug", "ordinal", ids.alias("ids")).where(F.size("ids").between(2, 40))
    last = usable.groupBy("slug").agg(F.max_by("ids", "ordinal").alias("ids"))
    return tag_index(last.select("slug", F.explode("ids").alias("item")))


def printings(spark: SparkSession, path: str) -> DataFrame:
    """(item, name, printed_text) of a JSON array with one object in each line; other lines go."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",+$", "").alias("value"))
    parsed = lines.where("value not in ('', '[', ']')").select(F.from_json("value", "oracle_id string, name string, printed_text string").alias("r"))
    return parsed.select("r.*").where("oracle_id <> '' and printed_text <> ''").withColumnRenamed("oracle_id", "item")


def pair_names(spark: SparkSession, path: str) -> DataFrame:
    """(name_a, name_b, role) of a CSV with a header."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    role = text("role") if "role" in rows.columns else F.lit("")
    return rows.select(F.col("card_a").alias("name_a"), F.col("card_b").alias("name_b"), role.alias("role"))


def eval_pairs(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """(a, b) of a curated file all of whose names must exist."""
    pairs, lost = curated_pairs(pair_names(spark, path), items)
    missing = [r["name"] for r in lost.distinct().orderBy("name").limit(20).collect()]
    if missing:
        raise ValueError(f"names without item: {missing}")
    return pairs.select("a", "b")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("oracle_id").alias("item"), F.col("cluster").alias("grp"))
