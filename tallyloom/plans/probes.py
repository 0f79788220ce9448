"""Files of probe pairs: mined ones, curated ones that hold, and candidates to be reviewed by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pairs
from ..sources import sinks

#: The curated set whose pairs mustn't be of one text.
WORDING = "same_effect_diff_wording"


def _named(found: DataFrame, items: DataFrame, role: str) -> DataFrame:
    name = lambda key, column: items.select(F.col("item").alias(key), F.col("name").alias(column))
    return found.join(name("a", "card_a"), "a").join(name("b", "card_b"), "b").select("card_a", "card_b", F.lit(role).alias("role"))


def _written(rows: DataFrame, folder: str, name: str) -> dict:
    path = f"{folder}/{name}.csv"
    sinks.write_csv(rows, path)
    return {"path": path, "n_written": rows.count()}


def build(items: DataFrame, curated: dict[str, DataFrame], taggings: DataFrame | None, folder: str) -> dict:
    """Write the probe sets of `items` (item, name, text, type_line, cost, ordinal) to `folder` as CSV
    (card_a, card_b, role), and say what was written and left out.

    `curated` names tables (name_a, name_b, role). Of each, pairs both of whose names exist are
    kept; of the wording set, pairs that were mined as of one text go there instead. With taggings
    (slug, item) there is a queue of candidates with an empty column to fill in."""
    mined = _named(pairs.identical_text_pairs(items), items, "identical_text").cache()
    found: dict = {"identical_text": _written(mined, folder, "identical_text")}
    try:
        same = mined.select(F.least("card_a", "card_b").alias("_lo"), F.greatest("card_a", "card_b").alias("_hi")).distinct()
        known = items.select(F.col("name").alias("_known")).where("_known is not null").distinct()
        for name, rows in curated.items():
            keyed = rows.withColumns({"_lo": F.least("name_a", "name_b"), "_hi": F.greatest("name_a", "name_b")})
            if name == WORDING:
                demoted = keyed.join(same, ["_lo", "_hi"], "left_semi").select("name_a", "name_b").orderBy("name_a", "name_b").collect()
                found["demoted_to_identical_text"] = [f"{r[0]} / {r[1]}" for r in demoted]
                keyed = keyed.join(same, ["_lo", "_hi"], "left_anti")
            names = keyed.select(F.explode(F.array("name_a", "name_b")).alias("_known")).distinct()
            missing = [r[0] for r in names.join(known, "_known", "left_anti").orderBy("_known").collect()]
            kept = keyed.join(known.withColumnRenamed("_known", "name_a"), "name_a", "left_semi").join(known.withColumnRenamed("_known", "name_b"), "name_b", "left_semi")
            written = _written(kept.select(F.col("name_a").alias("card_a"), F.col("name_b").alias("card_b"), "role"), folder, name)
            found[name] = written | {"n_dropped": keyed.count() - written["n_written"], "missing_names": missing}
        if taggings is not None:
            queue = sinks.review_queue(pairs.tag_candidates(items, taggings), items)
            found["tag_candidates"] = _written(queue, folder, "tag_candidates")
        found["numeric_mined"] = {"n": pairs.numeric_pairs(items).count()}
    finally:
        mined.unpersist()
    return found
