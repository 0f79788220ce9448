"""How often equivalent items get different encodings."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import GAP_MARKER, KEYWORD_MARKER, gap_category, marker_lines
from .canonical import FORMS, forms_column

# Thresholds of the verdict, and the pairs a tier needs.
PASS, FAIL, NUMERIC, ENOUGH = 0.10, 0.25, 0.05, 20
# Tiers with (mask numbers, mask symbols), and the one that is judged.
TIERS = {"reprints": (False, False), "identical_text": (False, False), "same_effect_wording": (False, False), "parametric_cycles": (True, True), "numeric": (True, False), "substitutes_contrast": (False, False)}
JUDGED = "same_effect_wording"


def encode(items: DataFrame, parser: Callable[[str], tuple[str | None, str | None]], column: str) -> DataFrame:
    """Adds (status, cdl, error, exclusion_reason, gap_category, n_gaps) by a parser that maps a value
    of `column` to (encoding, reason for exclusion); what it raises is a crash. A precomputed table
    of these columns serves as well."""

    @pandas_udf("cdl string, exclusion_reason string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                cdl, reason = parser(value)
                rows.append((cdl, reason, None))
            except Exception as failed:  # any failure is a measurement
                rows.append((None, None, f"{type(failed).__name__}: {failed}"))
        return pd.DataFrame(rows, columns=["cdl", "exclusion_reason", "error"])

    return with_markers(items.withColumn("_p", run(F.col(column))).select(*items.columns, "_p.*"))


def with_markers(encoded: DataFrame) -> DataFrame:
    """Adds status, number of gaps and the first gap's category to encodings."""
    gaps, unknown = marker_lines("cdl", GAP_MARKER), marker_lines("cdl", KEYWORD_MARKER)
    found = F.concat(gaps, unknown)
    status = F.when(F.col("exclusion_reason").isNotNull(), "excluded").when(F.col("error").isNotNull(), "crash").when(F.size(found) > 0, "gap").otherwise("clean")
    counted = F.when(status == "gap", F.size(found)).otherwise(0)
    return encoded.withColumn("gap_category", F.when(status == "gap", gap_category(F.element_at(found, 1)))).withColumn("n_gaps", counted).withColumn("status", status)


def wordings(reprints: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of wordings, those wordings (item, name, source) as items of their own) of `reprints` (item,
    text_a, text_b). `sources` (item, name, source) are JSON objects that a parser takes; a wording's is its item's
    with the wording as its text. Wordings of items without source, or with one that isn't an object, go."""

    @pandas_udf("string")
    def reworded(lines: pd.Series, texts: pd.Series) -> pd.Series:
        def one(line: str, words: str) -> str | None:
            try:
                return json.dumps(json.loads(line) | {"oracle_text": words})
            except (TypeError, ValueError):
                return None

        return pd.Series([one(line, words) for line, words in zip(lines, texts, strict=True)], dtype=object)

    of = lambda words: F.concat_ws("#", F.col("item").cast("string"), F.md5(words))
    pairs = reprints.select(of("text_a").alias("a"), of("text_b").alias("b"))
    texts = reprints.select("item", F.explode(F.array("text_a", "text_b")).alias("words")).distinct()
    made = texts.join(sources.select("item", "name", "source"), "item").select(of("words").alias("item"), "name", reworded("source", "words").alias("source"))
    return pairs, made.where("source is not null")


def score_pairs(pairs: DataFrame, encoded: DataFrame, mask_numbers: bool = False, mask_symbols: bool = False) -> DataFrame:
    """Pairs (a, b) with statuses, and whether the canonical forms differ in scope rules or full, read
    loosely or strictly. An item without encoding is excluded. Each distinct item is parsed once, and its
    four forms are joined to both sides as digests, with the text of one."""
    kept = encoded.select("item", "name", "cdl", "status").dropDuplicates(["item"])
    used = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    made = forms_column("cdl", "name", mask_numbers=mask_numbers, mask_symbols=mask_symbols)
    # texts are longer than they are estimated: they aren't for the driver to broadcast
    known = kept.join(used.hint("merge"), "item", "left_semi").select("item", "name", "status", made.alias("f"))
    side = lambda x: known.select(F.col("item").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("name", "status", "f")])
    joined = pairs.join(side("a").hint("merge"), "a", "left").join(side("b").hint("merge"), "b", "left")
    status = {x: F.coalesce(f"status_{x}", F.lit("excluded")) for x in "ab"}
    both_encoded = status["a"].isin("clean", "gap") & status["b"].isin("clean", "gap")
    return joined.select(
        *pairs.columns, status["a"].alias("status_a"), status["b"].alias("status_b"),
        ((status["a"] == "clean") & (status["b"] == "clean")).alias("both_clean"), both_encoded.alias("both_encoded"),
        *[F.when(both_encoded, F.col(f"f_a.{f}") != F.col(f"f_b.{f}")).alias(f"diverge_{f}") for f in FORMS],
        F.when(both_encoded, F.col("f_a.text")).alias("canonical_a"), F.when(both_encoded, F.col("f_b.text")).alias("canonical_b"), "name_a", "name_b",
    )


def rates(scored: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates of divergence (null where there is nothing), and where none was seen the upper
    bound that so many pairs support."""
    share = lambda flag, column: F.avg(F.when(F.col(flag), F.col(column).cast("int")))
    clean = F.count_if(F.col("both_clean"))
    seen = F.coalesce(F.sum(F.when(F.col("both_clean"), F.col("diverge_rules_loose").cast("int"))), F.lit(0))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), clean.alias("n_both_clean"), F.count_if(F.col("both_encoded")).alias("n_both_encoded"),
        share("both_clean", "diverge_rules_loose").alias("clean_rules_loose"), share("both_clean", "diverge_rules_strict").alias("clean_rules_strict"),
        share("both_clean", "diverge_full_loose").alias("clean_full_loose"), share("both_encoded", "diverge_rules_loose").alias("all_rules_loose"),
        upper_bound(seen, clean).alias("upper_bound"), (clean < ENOUGH).alias("underpowered"),
    )


def upper_bound(seen: Column, n: Column) -> Column:
    """Rule of three: 3 / n if none of n diverged."""
    return F.when((seen == 0) & (n > 0), F.lit(3.0) / n)


def verdict(divergence: Column, numeric: Column) -> Column:
    base = F.when(divergence > FAIL, "FAIL").when(divergence < PASS, "PASS").otherwise("PARTIAL")
    return F.when((base == "PASS") & (F.coalesce(numeric, F.lit(0.0)) >= NUMERIC), "PARTIAL").otherwise(base)


def judged(tiers: DataFrame) -> DataFrame:
    """(aggregate, numeric, verdict) over the rates of tiers (column `tier`): the judged tier, else
    the first in order; a pass on few pairs says so, and without a rate there is no data."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")), F.lit(99))
    place = F.struct(F.when(F.col("tier") == JUDGED, 0).otherwise(order), F.col("clean_rules_loose").alias("rate"), "underpowered")
    found = tiers.agg(F.min(place).alias("p"), F.max(F.when(F.col("tier") == "numeric", F.col("clean_rules_loose"))).alias("numeric"))
    plain = F.when(F.col("p.rate").isNull(), "NO DATA").otherwise(verdict(F.col("p.rate"), F.col("numeric")))
    return found.select(F.col("p.rate").alias("aggregate"), "numeric", F.when((plain == "PASS") & F.col("p.underpowered"), "PASS (UNDERPOWERED)").otherwise(plain).alias("verdict"))
