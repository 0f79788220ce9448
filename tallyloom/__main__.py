"""Run a gate over files: python -m tallyloom coverage|divergence|leakage|probes|thresholds --help"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import stratum
from .operators import divergence, examples, pairs, similarity
from .operators.parsers import Parser, ParserUnavailable
from .plans import gates, probes, reports
from .session import session
from .sources import readers

#: The verdict on rungs that score given vectors.
NOT_TRAINED = "NOT_TRAINED"
#: Baskets and positives of a trial run.
SMOKE_COVERAGE, SMOKE_LEAKAGE, SMOKE_POSITIVES = 200, 300, 200


def _named(text: str) -> tuple[str, str]:
    name, mark, path = text.partition("=")
    if not mark:
        raise argparse.ArgumentTypeError(f"{text!r} isn't name=path")
    return name, path


def _items(spark: SparkSession, path: str) -> DataFrame:
    """Items (item, ordinal, name, text, type_line, cost, colours) of a table of items."""
    rows = readers.items_parquet(spark, path)
    return rows.select(F.col("oracle_id").alias("item"), F.col("oracle_id").alias("ordinal"), "name", F.col("oracle_text").alias("text"), "type_line", F.col("cmc").alias("cost"), F.col("color_identity").alias("colours"))


def _baskets(spark: SparkSession, kind: str, path: str, items: DataFrame, limit: int | None) -> DataFrame:
    found = readers.corpus(kind)(spark, path, items, limit) if kind == "casual" else readers.corpus(kind)(spark, path, limit)
    return (found[0] if isinstance(found, tuple) else found).select("basket", "item")


def _encoded(spark: SparkSession, args: argparse.Namespace, items: DataFrame) -> tuple[DataFrame, str, DataFrame | None, Parser | None]:
    """Items with encodings and statuses, where they are from, and what a parser made them of: a table that has
    them, or the snapshot's lines (item, name, source) by a parser."""
    if args.encoded:
        rows = spark.read.parquet(args.encoded)
        return (rows if "status" in rows.columns else divergence.with_markers(rows)), args.encoded, None, None
    parser = Parser(args.parser, args.encode, args.exclude)
    described = parser.describe()
    lines = spark.read.text(args.snapshot).select(F.get_json_object("value", "$.oracle_id").alias("item"), F.col("value").alias("source")).where("item <> ''").dropDuplicates(["item"])
    sources = items.join(lines, "item", "left")
    return divergence.encode(sources, parser, "source").drop("source"), described, sources, parser


def _with_flags(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("ok", F.col("status") == "clean").withColumn("encoded", F.col("status").isin("clean", "gap"))


def run_coverage(spark: SparkSession, args: argparse.Namespace) -> None:
    items = _items(spark, args.items)
    encoded, described, _, _ = _encoded(spark, args, items)
    parsed, limit = _with_flags(encoded), SMOKE_COVERAGE if args.smoke else args.limit
    folder = f"{args.findings}/smoke" if args.smoke else args.findings
    results = {kind: gates.run_coverage(parsed, _baskets(spark, kind, path, items, limit), folder, kind) for kind, path in args.corpus}
    run_args = {"corpora": [k for k, _ in args.corpus], "limit": limit, "parser": described}
    gates.report(spark, folder, "t0_coverage", {"results": results}, reports.coverage_report(results), [args.items, *(p for _, p in args.corpus)], run_args)


def run_divergence(spark: SparkSession, args: argparse.Namespace) -> None:
    items = _items(spark, args.items)
    encoded, described, sources, parser = _encoded(spark, args, items)
    tiers, skips = {"numeric": pairs.numeric_pairs(items).withColumnRenamed("template", "note"), "identical_text": pairs.identical_text_pairs(items)}, {}
    for name, path in args.pairs:
        found, lost = pairs.curated_pairs(readers.pair_names(spark, path), items)
        missing = [r[0] for r in lost.distinct().orderBy("name").limit(20).collect()]
        if missing:
            skips[f"{name} (names without item)"] = ", ".join(missing)
        tiers[name] = found.withColumnRenamed("role", "note")
    if not args.printings:
        skips["reprints"] = "no table of all printings is named"
    elif parser is None:
        skips["reprints"] = "encodings are given, and wordings need a parser"
    else:
        # wordings of an item are items of their own to the parser
        found, worded = divergence.wordings(pairs.reprint_pairs(readers.printings(spark, args.printings)), sources)
        tiers["reprints"] = found
        made = divergence.encode(worded, parser, "source").drop("source")
        encoded = encoded.unionByName(made, allowMissingColumns=True)
    ordered = {name: tiers[name] for name in sorted(tiers, key=lambda t: list(divergence.TIERS).index(t) if t in divergence.TIERS else 99)}
    for name in [n for n, rows in ordered.items() if not rows.take(1)]:
        skips[name] = "no pairs"
        del ordered[name]
    found = gates.run_divergence(ordered, encoded, args.findings)
    gates.report(spark, args.findings, "t1_divergence", found | {"skips": skips}, reports.divergence_report(found, skips), [args.items, *(p for _, p in args.pairs)], {"parser": described, "printings": args.printings})


def run_leakage(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.merge:
        merged = gates.merge_files(spark, args.findings)
        gates.report(spark, args.findings, "t2_leakage", merged, reports.leakage_report(merged["results"], merged["harness"]), [], merged["run_args"])
        return
    items = _items(spark, args.items)
    most = SMOKE_POSITIVES if args.smoke else args.max_positives
    evals, groups = readers.eval_pairs(spark, args.eval_pairs, items), readers.clusters(spark, args.clusters)
    strata = items.select("item", stratum("colours", "cost", "type_line").alias("grp"))
    # vectors that are given are the same ones for every rung, so nothing can be said of what a rung trains
    vectors = spark.read.parquet(args.vectors) if args.vectors else None
    rungs = [(arm, kind, path) for kind, path in args.corpus for arm in args.arms if (arm == "2a") == (kind == "precon")]
    results = []
    for arm, kind, path in rungs:
        baskets = _baskets(spark, kind, path, items, SMOKE_LEAKAGE if args.smoke else args.limit)
        provider = None if vectors is None else examples.existing_vectors(vectors)
        found = gates.run_arm(arm, kind, baskets, items, evals, groups, strata, vectors, provider, most)
        results.append(found if vectors is None else found | {"verdict": NOT_TRAINED})
    first = next((r["curated"] for r in results if r["arm"] == "2a"), {})
    harness = similarity.harness(first.get("mean_substitute_cosine"), first.get("mean_random_cluster_cosine"))
    name = f"t2_leakage_partial_{args.tag}" if args.tag else "t2_leakage"
    run_args = {"corpora": [k for k, _ in args.corpus], "arms": args.arms, "max_positives": most, "limit": args.limit, "smoke": args.smoke}
    gates.report(spark, args.findings, name, {"results": results, "harness": harness}, reports.leakage_report(results, harness, [r[:2] for r in rungs]), [args.items, args.eval_pairs, args.clusters, *([args.vectors] if args.vectors else []), *(p for _, p in args.corpus)], run_args)


def run_probes(spark: SparkSession, args: argparse.Namespace) -> None:
    curated = {name: readers.pair_names(spark, path) for name, path in args.pairs}
    found = probes.build(_items(spark, args.items), curated, readers.tags(spark, args.tags) if args.tags else None, args.out)
    print(json.dumps(found, indent=2, sort_keys=True))


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    top.add_argument("--checkpoints", help="a folder that all executors share")
    kinds = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *, corpora: bool = False, parser: bool = False, curated: bool = False, findings: bool = True) -> argparse.ArgumentParser:
        made = kinds.add_parser(name)
        made.set_defaults(run=run)
        made.add_argument("--items", help="Parquet table of items")
        if corpora:
            made.add_argument("--corpus", nargs="+", type=_named, default=[], metavar="KIND=PATH", help="casual, cedh or precon, and its file")
            made.add_argument("--limit", type=int, help="baskets of each corpus, at most")
            made.add_argument("--smoke", action="store_true", help="a trial run on few baskets")
        if parser:
            made.add_argument("--encoded", help="Parquet table of items with encodings, in place of a parser")
            made.add_argument("--parser", help="folder of a parser")
            made.add_argument("--encode", default="parser:encode", help="module:function")
            made.add_argument("--exclude", help="module:function that says why an item is left out")
            made.add_argument("--snapshot", help="JSON lines that the parser takes")
        if curated:
            made.add_argument("--pairs", nargs="+", type=_named, default=[], metavar="NAME=PATH", help="CSV files of curated pairs")
        if findings:
            made.add_argument("--findings", default="findings", help="folder of the results")
        return made

    command("coverage", run_coverage, corpora=True, parser=True)
    command("divergence", run_divergence, parser=True, curated=True).add_argument("--printings", help="JSON of all printings")
    leakage = command("leakage", run_leakage, corpora=True)
    leakage.add_argument("--arms", nargs="+", choices=gates.ARMS, default=list(gates.ARMS))
    leakage.add_argument("--eval-pairs", help="CSV of curated pairs")
    leakage.add_argument("--clusters", help="Parquet of (oracle_id, cluster)")
    leakage.add_argument("--vectors", help="Parquet of (item, vector) that every rung scores, in place of training")
    leakage.add_argument("--max-positives", type=int, default=gates.MOST, help="0 for all")
    leakage.add_argument("--tag", help="write a partial result of this name")
    leakage.add_argument("--merge", action="store_true", help="join all partial results, and nothing else")
    builder = command("probes", run_probes, curated=True, findings=False)
    builder.add_argument("--tags", help="JSON lines of tags")
    builder.add_argument("--out", default="probe_sets")
    lint = kinds.add_parser("thresholds")
    lint.add_argument("--document", default=str(Path(__file__).parents[1] / "THRESHOLDS.md"))
    return top.parse_args(words)


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(words)
    if args.command == "thresholds":
        problems = gates.out_of_sync(Path(args.document).read_text())
        print("\n".join(problems) or "all thresholds are in the document")
        return int(bool(problems))
    try:
        args.run(spark or session(checkpoints=args.checkpoints), args)
    except ParserUnavailable as missing:
        print(missing)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
