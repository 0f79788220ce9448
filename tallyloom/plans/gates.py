"""The three gates as pipelines: coverage, divergence, leakage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import SEED
from ..operators import cooccurrence as C
from ..operators import coverage, divergence, encoder, examples, similarity, training
from ..sources import sinks
from .reports import CONFOUND

ARMS = ("2a", "2b", "2c", "2d")
#: Fixed value: positives that a rung trains on, at most, unless another number is given.
MOST = 250_000


def thresholds() -> dict:
    """All thresholds of the verdicts: the one place they are read from."""
    return {
        "t0": {"pass": coverage.PASS, "fail": coverage.FAIL, "guard_max_drop": coverage.GUARD_DROP},
        "t1": {"pass": divergence.PASS, "fail": divergence.FAIL, "numeric_max": divergence.NUMERIC},
        "t2": {"min_lift": similarity.MIN_LIFT, "bootstrap_n": similarity.REPLICATES, "ci": similarity.LEVEL, "generalization_ratio": similarity.RATIO, "baseline_substitute": similarity.REFERENCE[0], "baseline_random": similarity.REFERENCE[1], "baseline_tol": similarity.TOLERANCE},
        "confound_note": CONFOUND,
    }


def out_of_sync(document: str) -> list[str]:
    """Thresholds whose value, as it is written there, isn't in the document."""
    share, signed = lambda v: f"{100 * v:g}%", lambda v: f"{v:+g}"
    written = {
        "t0 pass": share(coverage.PASS), "t0 fail": share(coverage.FAIL), "t0 guard": f"{100 * coverage.GUARD_DROP:g} percentage points",
        "t1 pass": share(divergence.PASS), "t1 fail": share(divergence.FAIL), "t1 numeric": share(divergence.NUMERIC),
        "t2 lift": signed(similarity.MIN_LIFT), "t2 interval": share(similarity.LEVEL), "t2 substitutes": f"{similarity.REFERENCE[0]:g}", "t2 random": f"{similarity.REFERENCE[1]:g}",
    }
    return [f"{name} ({value}) isn't in the document" for name, value in written.items() if value not in document]


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _whole(rows: DataFrame, folder: str | None, name: str) -> list[dict] | dict:
    """All rows: written as CSV to a folder, of which the path and the count come back, or collected
    where no folder is given."""
    if folder is None:
        return _rows(rows)
    path = f"{folder}/{name}"
    sinks.write_csv(rows, path)
    return {"path": path, "count": rows.count()}


def failure_rows(items: DataFrame) -> DataFrame:
    """The failures with most appearances, with the columns of their file."""
    found = coverage.failures(items)
    kept = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("name", "type_line", "appearances", "status", "gap_category", "exclusion_reason", "error")]
    return found.select(F.col("item").alias("oracle_id"), *kept)


def run_coverage(parsed: DataFrame, baskets: DataFrame, folder: str | None = None, corpus: str = "corpus") -> dict:
    """Gate T0: coverage of one corpus, in all its breakdowns. All that is collected is a bounded
    number of rows, but for exclusion reasons, which go to `folder` if there is one, as do failures."""
    items = coverage.weighed(parsed, baskets).cache()
    try:
        return {
            "strata": _rows(coverage.strata(items)), "heads": _rows(coverage.head_breakouts(items, baskets)), "status_share": _rows(coverage.status_share(items)),
            "encoded": _rows(coverage.weighted_coverage(items, "encoded"))[0], "exclusion_reasons": _whole(coverage.exclusion_reasons(items), folder, f"t0_exclusion_reasons_{corpus}.csv"),
            "gap_categories": _rows(coverage.gap_categories(items)), "distinct": _rows(coverage.distinct_coverage(items))[0], "unmatched": _rows(coverage.unmatched(parsed, baskets))[0],
            "failures": _whole(failure_rows(items), folder, f"t0_failures_{corpus}.csv"), "verdict": _rows(coverage.judged(items))[0],
            "n_baskets": baskets.select("basket").distinct().count(), "staples": sorted(str(r["name" if "name" in parsed.columns else "item"]) for r in items.where("staple").collect()),
        }
    finally:
        items.unpersist()


def run_divergence(tiers: dict[str, DataFrame], encoded: DataFrame, folder: str | None = None) -> dict:
    """Gate T1: each tier's pairs (a, b) scored with its masks; the verdict over all tiers. Every
    divergent pair goes with both forms to `folder` if there is one."""
    scored = []
    for tier, pairs in tiers.items():
        numbers, symbols = divergence.TIERS.get(tier, (False, False))
        note = F.col("note").cast("string") if "note" in pairs.columns else F.lit("")
        scored.append(divergence.score_pairs(pairs.select("a", "b", note.alias("note")), encoded, numbers, symbols).withColumn("tier", F.lit(tier)))
    together = reduce(DataFrame.unionByName, scored).cache()
    try:
        by_tier = divergence.rates(together, "tier")
        divergent = together.where("diverge_rules_loose").orderBy("tier", "a", "b").select(F.col("tier").alias("source"), "name_a", "name_b", "note", "canonical_a", "canonical_b")
        return {"sets": _rows(by_tier), "verdict": _rows(divergence.judged(by_tier))[0], "divergent": _whole(divergent, folder, "t1_divergent_pairs.csv")}
    finally:
        together.unpersist()


def _score(pairs: DataFrame, vectors: DataFrame, clusters: DataFrame, strata: DataFrame, seed: int, replicates: int) -> dict:
    numbered = pairs.select(F.concat_ws("|", "a", "b").alias("pair"), "a", "b")
    found = {}
    for name, grouping, s in (("cluster", clusters, seed), ("stratum", strata, seed + 1)):
        cosines = similarity.substitute_and_control(numbered, vectors, grouping, s).cache()
        point, ends = _rows(similarity.lift(cosines))[0], _rows(similarity.bootstrap(cosines, replicates, seed=s))[0]
        cosines.unpersist()
        found |= {"n_pairs_in_vocab": point["n_substitute"], "mean_substitute_cosine": point["mean_substitute"], f"mean_random_{name}_cosine": point["mean_random"], f"lift_vs_{name}": point["lift"], f"lift_vs_{name}_ci": [ends["ci_low"], ends["ci_high"]]}
    return found


@contextmanager
def _kept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Caches rows until the end."""
    held: list[DataFrame] = []

    def keep(rows: DataFrame) -> DataFrame:
        held.append(rows.cache())
        return held[-1]

    try:
        yield keep
    finally:
        for rows in held:
            rows.unpersist()


def run_arm(
    arm: str, corpus: str, baskets: DataFrame, items: DataFrame, eval_pairs: DataFrame, clusters: DataFrame, strata: DataFrame, zero_shot: DataFrame | None = None, provider: examples.Provider | None = None,
    most: int | None = MOST, replicates: int = similarity.REPLICATES, seed: int = SEED, dimensions: int = encoder.DIMENSIONS,
) -> dict:
    """Gate T2, one rung. 2a and 2b train on positives alone, 2c adds hard negatives, 2d also phenotype
    pairs, which never include what is held out. `items` is (item, text, colours); the provider
    gives the vectors that are scored, by default those of the encoder after training on the rung's examples. Phenotype
    pairs are mined with `zero_shot` vectors, by default the encoder's. `most` caps the positives by a random
    choice; None or 0 doesn't."""
    if arm not in ARMS:
        raise ValueError(f"an arm is one of {', '.join(ARMS)}, not {arm!r}")
    spark = baskets.sparkSession
    provider = provider or training.trained_provider(dimensions, seed=seed)
    with _kept() as keep:
        values = keep(C.ppmi(C.cooccurrence(baskets)))
        mined = keep(C.mined(values, eval_pairs))
        strict, total = C.strict_ones(mined, eval_pairs).count(), mined.count()
        if not total:
            raise ValueError(f"{arm}/{corpus}: no positive pairs")
        split = keep(C.holdout(C.cap(mined, most, seed), seed=seed))
        held, train = split.where("split = 'holdout'").select("a", "b"), split.where("split = 'train'").select("a", "b")
        negatives, extra = None, {"positive": 0, "negative": 0}
        if arm in ("2c", "2d"):
            vocabulary = baskets.select("item").distinct()
            negatives = keep(C.hard_negatives(values, items.select("item", "colours"), vocabulary, eval_pairs, split, seed=seed))
        if arm == "2d":
            vectors = encoder.encode(items.select("item", "text"), dimensions=dimensions, seed=seed) if zero_shot is None else zero_shot
            found = keep(C.phenotype_pairs(values, vectors, eval_pairs, seed=seed))
            extra |= {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
            apart = C.without_pairs(found.where("kind = 'positive'").select("a", "b"), held.select(*C.unordered()))
            train, negatives = train.unionByName(apart), negatives.unionByName(found.where("kind = 'negative'").select("a", "b"))
        ordered = examples.numbered(train, "a", "b")
        made = keep(examples.training_examples(ordered, None if negatives is None else examples.numbered(negatives, "a", "b"), items.select("item", "text")))
        vectors = keep(provider(made, items))
        curated, mined_score = _score(eval_pairs, vectors, clusters, strata, seed, replicates), _score(held, vectors, clusters, strata, seed + 100, replicates)
        one = spark.createDataFrame([(curated["lift_vs_cluster"], curated["lift_vs_cluster_ci"][0], mined_score["lift_vs_cluster"])], "l double, c double, m double")
        judged = one.select(similarity.verdict(F.col("l"), F.col("c"), F.col("m")).alias("verdict"), similarity.narrow_effect(F.col("l"), F.col("m")).alias("narrow")).first()
        return {
            "arm": arm, "corpus": corpus, "n_decks": baskets.select("basket").distinct().count(), "n_cards_vocab": baskets.select("item").distinct().count(),
            "n_positives_mined_total": total, "n_positives_mined": split.count(), "n_positives_strict": strict, "n_positives_trained": train.count(),
            "n_negatives": 0 if negatives is None else negatives.count(), "n_holdout_positives": held.count(), "n_extra_positives_2d": extra["positive"], "n_extra_negatives_2d": extra["negative"],
            "n_examples": made.count(), "curated": curated, "mined_holdout": mined_score, "verdict": judged["verdict"], "narrow_effect": judged["narrow"],
        }


def merge_results(partials: list[DataFrame]) -> DataFrame:
    """Results (arm, corpus, ...) of runs on their own, whose columns may differ; the same rung twice is
    an error."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), partials)
    twice = merged.groupBy("arm", "corpus").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"rungs that ran twice: {[(r['arm'], r['corpus']) for r in twice]}")
    return merged


def partial_results(spark: SparkSession, folder: str, pattern: str = "t2_leakage_partial_*.json") -> DataFrame:
    """(path, place, arm, corpus, result) of the results in a folder's findings, in order; the same rung twice is an
    error. `result` is a variant, so files may differ in what a result holds and in its types."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    # Python writes numbers that JSON doesn't know
    known = F.regexp_replace("value", r"(?<=[:,\[])(\s*)(?:NaN|-?Infinity)(?=\s*[,\]}])", "$1null")
    files = raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json(known).alias("found"))
    broken = [r["path"] for r in files.where("found is null").select("path").limit(5).collect()]
    if broken:
        raise ValueError(f"not JSON: {broken}")
    results = files.select("path", F.posexplode(F.try_variant_get("found", "$.results", "array<variant>")).alias("place", "result"))
    named = results.select("path", "place", *[F.try_variant_get("result", f"$.{k}", "string").alias(k) for k in ("arm", "corpus")], "result")
    twice = named.groupBy("arm", "corpus").agg(F.count("*").alias("n"), F.max("path").alias("path")).where("n > 1").orderBy("arm", "corpus").limit(5).collect()
    if twice:
        raise ValueError(f"rungs that ran twice: {[(r['arm'], r['corpus'], r['path']) for r in twice]}")
    return named


def merge_files(spark: SparkSession, folder: str, pattern: str = "t2_leakage_partial_*.json") -> dict:
    """Findings of partial runs in a folder as one, with the comparison to the reference means. There are as many
    results as rungs; they reach the driver for the report."""
    found = partial_results(spark, folder, pattern).orderBy("path", "place")
    rows = found.select("path", F.to_json("result").alias("body"), *[F.try_variant_get("result", f"$.curated.{k}", "double").alias(k) for k in ("mean_substitute_cosine", "mean_random_cluster_cosine")], "arm").collect()
    first = next((r for r in rows if r["arm"] == "2a"), None)
    means = (first["mean_substitute_cosine"], first["mean_random_cluster_cosine"]) if first else (None, None)
    return {"results": [json.loads(r["body"]) for r in rows], "harness": similarity.harness(*means), "run_args": {"merged_from": sorted({r["path"] for r in rows})}}


def report(spark: SparkSession, folder: str, name: str, findings: dict, text: str, inputs: list[str], run_args: dict | None = None) -> None:
    """Findings with provenance and thresholds as JSON, and their report as Markdown."""
    sinks.write_findings(spark, folder, name, sinks.envelope(spark, inputs, thresholds(), run_args) | findings, text)
