"""Readers and sinks as queries: tables are written in the layout that a reader takes, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import tasks_for, through_files
from ..operators import pairs
from ..sources import readers, sinks
from . import gates, probes, queries
from .queries import SQL, _part_items, _query, _t


def _ordered(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows in order of the keys over the files that are written; there are as many files as so many rows need."""
    return df.repartitionByRange(max(4, tasks_for(rows)), *keys).sortWithinPartitions(*keys)


@_query("SELECT p_partkey::VARCHAR AS item, p_name AS name, p_type AS oracle_text, p_brand AS type_line, p_size::DOUBLE AS cmc, p_brand AS colour FROM part WHERE p_size > 1")
def item_snapshot(spark, d):
    """Gzipped JSON lines with two versions of each item, the last of which counts, and lines without id."""
    part = _t(spark, d, "part").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("version"))
    name = F.when(F.col("version") == 1, F.col("p_name")).otherwise(F.lit("old"))
    cards = _ordered(part, 2 * _t(spark, d, "part").count(), "p_partkey", "version").select(F.when(F.col("p_size") > 1, F.col("p_partkey").cast("string")).otherwise(F.lit("")).alias("oracle_id"), name.alias("name"), F.col("p_type").alias("oracle_text"), F.col("p_brand").alias("type_line"), F.col("p_size").cast("double").alias("cmc"), F.array("p_brand").alias("color_identity"))
    found = through_files(spark, lambda f: cards.write.option("compression", "gzip").json(f), lambda f: readers.item_snapshot(spark, f))
    return found.select("item", "name", "oracle_text", "type_line", "cmc", F.element_at("color_identity", 1).alias("colour"))


@_query("SELECT p_partkey AS oracle_id, p_name AS name FROM part")
def items_table(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("oracle_id"), F.col("p_name").alias("name"))
    return through_files(spark, rows.write.parquet, lambda f: readers.items_parquet(spark, f))


_LISTED = "SELECT o_orderkey AS deck, strftime(o_orderdate, '%Y-%m-%d') AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS commander, CASE o_orderkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN n_name || ' // x' WHEN 2 THEN 'nobody' ELSE n_name END AS one, r_name AS two, n_name, n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_RESOLVED = f"SELECT deck, 'archidekt:' || deck AS basket, coalesce(commander, '') AS commander, created_at, n_nationkey AS item FROM ({_LISTED}) WHERE deck % 4 <> 2"


def _named_baskets(spark, d, limit=None):
    orders, customer, nation, region = (_t(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    kind, name = F.col("o_orderkey") % 4, F.col("n_name")
    one = F.when(kind == 0, F.upper(name)).when(kind == 1, F.concat(name, F.lit(" // x"))).when(kind == 2, "nobody").otherwise(name)
    decks = _ordered(rows, orders.count(), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("deck_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("commander"), F.array(one, "r_name").alias("card_names"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    named = nation.select(F.col("n_nationkey").alias("item"), F.col("n_nationkey").alias("ordinal"), F.when(F.col("n_nationkey") >= 0, F.concat(name, F.lit(" // x"))).alias("name"))
    plain = nation.select(F.col("n_nationkey").alias("item"), F.col("n_nationkey").alias("ordinal"), name.alias("name"))
    return through_files(spark, decks.write.json, lambda f: readers.named_baskets(spark, f, named.unionByName(plain), limit)[0])


@_query(f"SELECT basket, commander, created_at, item FROM ({_RESOLVED})")
def named_baskets(spark, d):
    return _named_baskets(spark, d)


@_query(f"SELECT basket, commander, created_at, item FROM ({_RESOLVED} ORDER BY deck LIMIT 100)")
def named_baskets_limited(spark, d):
    return _named_baskets(spark, d, 100)


_ROWS = "SELECT l_orderkey AS deck, l_partkey::VARCHAR AS item, CASE WHEN l_linenumber > 1 THEN o_orderpriority END AS commander, CASE WHEN l_returnflag = 'R' THEN 'other' ELSE 'edhtop16' END AS source, CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 5 > 0 END AS valid FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _deck_sql(prefix: str, where: str) -> str:
    return f"SELECT DISTINCT '{prefix}:' || deck AS basket, coalesce(max(commander) OVER (PARTITION BY deck), '') AS commander, item FROM ({_ROWS}) WHERE valid AND {where}"


def _deck_rows(spark, d):
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.col("l_linenumber")
    return rows.select(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").cast("string").alias("oracle_id"), F.when(line > 1, F.col("o_orderpriority")).alias("commander_name"), F.when(F.col("l_returnflag") == "R", "other").otherwise(readers.TOURNAMENT).alias("source"), F.when(~((F.col("l_linestatus") == "F") & (line % 3 == 0)), line % 5 > 0).alias("temporally_valid"))


@_query(_deck_sql("edhtop16", "source = 'edhtop16'"))
def tournament_baskets(spark, d):
    return through_files(spark, _deck_rows(spark, d).write.parquet, lambda f: readers.corpus("cedh")(spark, f))


@_query(_deck_sql("precon", "true"))
def fixed_baskets(spark, d):
    return through_files(spark, _deck_rows(spark, d).write.parquet, lambda f: readers.corpus("precon")(spark, f))


@_query(_deck_sql("precon", "deck IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 200)"))
def fixed_baskets_limited(spark, d):
    rows = _ordered(_deck_rows(spark, d), _t(spark, d, "lineitem").count(), "deck_id", "oracle_id")
    return through_files(spark, rows.write.parquet, lambda f: readers.fixed_baskets(spark, f, 200))


@_query("SELECT DISTINCT slug, item FROM (SELECT slug, item, count(DISTINCT item) OVER (PARTITION BY slug) AS n FROM (SELECT CASE WHEN p_size = 7 THEN 'art-' ELSE 'does-' END || lower(p_type) || '-' || p_size || '-' || p_partkey % 31 AS slug, p_partkey::VARCHAR AS item FROM part)) WHERE n BETWEEN 2 AND 40 AND NOT starts_with(slug, 'art-')")
def tag_table(spark, d):
    """JSON lines of tags, whose taggings are an array or, for every other size, a Python literal."""
    size = F.col("p_size")
    slug = F.concat(F.when(size == 7, "art-").otherwise("does-"), F.lower("p_type"), F.lit("-"), size.cast("string"), F.lit("-"), (F.col("p_partkey") % 31).cast("string"))
    rows = _t(spark, d, "part").groupBy(slug.alias("slug"), (size % 2).alias("literal")).agg(F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))).alias("ids"))
    literal = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("{'oracle_id': '"), x, F.lit("'}"))), ", "), F.lit("]"))
    as_array = F.to_json(F.struct("slug", F.transform("ids", lambda x: F.struct(x.alias("oracle_id"))).alias("taggings")))
    lines = rows.select(F.when(F.col("literal") == 1, F.to_json(F.struct("slug", literal.alias("taggings")))).otherwise(as_array).alias("value"))
    return through_files(spark, lines.write.option("compression", "gzip").text, lambda f: readers.tags(spark, f)).distinct()


@_query("SELECT item, text_a, text_b, wordings FROM (SELECT item, text AS text_a, lead(text) OVER (PARTITION BY item ORDER BY text) AS text_b, count(*) OVER (PARTITION BY item) AS wordings FROM (SELECT DISTINCT o_custkey::VARCHAR AS item, o_orderstatus || ' of ' || o_orderpriority AS text FROM orders WHERE o_orderkey % 9 > 0)) WHERE text_b IS NOT NULL")
def reprint_pairs(spark, d):
    """An array of printings, one object in each line; empty texts go, runs of blanks don't matter."""
    wording = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.col("o_orderstatus"), F.lit("  of "), F.col("o_orderpriority"))).otherwise("")
    objects = _t(spark, d, "orders").select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("oracle_id"), F.lit("x").alias("name"), wording.alias("printed_text"))).alias("value"))
    lines = spark.createDataFrame([("[",), ("]",)], "value string").unionByName(objects.select(F.concat("value", F.lit(",")).alias("value")))
    return through_files(spark, lines.write.text, lambda f: pairs.reprint_pairs(readers.printings(spark, f)))


_CURATED = "SELECT x.n_name AS name_a, CASE WHEN x.n_nationkey % 7 = 3 THEN 'gone' ELSE y.n_name END AS name_b, r_name || ', \"near\"' AS role, x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1 JOIN region ON x.n_regionkey = r_regionkey"


def _curated(spark, d):
    """Neighbouring nations, some with a name that is gone, and nations as items."""
    nation = _t(spark, d, "nation")
    near = nation.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("other"))
    rows = nation.join(near, F.col("n_nationkey") == F.col("k")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = rows.select(F.col("n_name").alias("card_a"), F.when(F.col("n_nationkey") % 7 == 3, "gone").otherwise(F.col("other")).alias("card_b"), F.concat("r_name", F.lit(', "near"')).alias("role"))
    items = nation.select(F.col("n_nationkey").alias("item"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"))
    return named, items


def _as_csv(rows: DataFrame):
    return lambda folder: rows.write.option("header", True).option("escape", '"').csv(folder)


@_query(f"SELECT a, b, role FROM ({_CURATED}) WHERE name_b <> 'gone'")
def curated_pairs(spark, d):
    named, items = _curated(spark, d)
    return through_files(spark, _as_csv(named), lambda f: pairs.curated_pairs(readers.pair_names(spark, f), items)[0])


@_query(f"SELECT a, b FROM ({_CURATED}) WHERE name_b <> 'gone'")
def eval_pairs(spark, d):
    named, items = _curated(spark, d)
    return through_files(spark, _as_csv(named.where("card_b <> 'gone'")), lambda f: readers.eval_pairs(spark, f, items))


@_query(f"SELECT a, b, a % 5 = 0 AS identical FROM ({_CURATED}) WHERE name_b <> 'gone'")
def checked_pairs(spark, d):
    named, items = _curated(spark, d)
    same = items.where("item % 5 = 0").select((F.col("item") + 1).alias("a"), F.col("item").alias("b"))
    kept, identical = pairs.checked_pairs(named.withColumnsRenamed({"card_a": "name_a", "card_b": "name_b"}), items, same)
    return kept.select("a", "b", F.lit(False).alias("identical")).unionByName(identical.select("a", "b", F.lit(True).alias("identical")))


@_query("SELECT vec_id::VARCHAR AS item, label AS grp FROM embeddings")
def clusters(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("oracle_id"), F.col("label").alias("cluster"))
    return through_files(spark, rows.write.parquet, lambda f: readers.clusters(spark, f))


@_query("SELECT item::VARCHAR AS oracle_id, type_line, appearances::VARCHAR AS appearances, status, gap_category, exclusion_reason FROM part_items WHERE NOT ok ORDER BY part_items.appearances DESC, item LIMIT 200")
def failure_file(spark, d):
    def written(folder):
        sinks.write_csv(gates.failure_rows(_part_items(spark, d)), folder)

    return through_files(spark, written, lambda f: spark.read.option("header", True).csv(f)).drop("name", "error")


@_query(f"""SELECT 'identical_text' AS file, count(*) AS n FROM (SELECT b FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_name || p_type || p_size ORDER BY 'part ' || p_partkey, p_partkey) AS b FROM part) WHERE b IS NOT NULL LIMIT 800)
UNION ALL SELECT 'nations', count(*) FROM ({_CURATED}) WHERE name_b <> 'gone' UNION ALL SELECT 'missing', count(DISTINCT name_b) FROM ({_CURATED}) WHERE name_b = 'gone'""")
def probe_files(spark, d):
    """The builder's files, counted after they are read back."""
    named, nations = _curated(spark, d)
    part = _t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws(" ", F.lit("a text of its own:"), "p_name", "p_type", "p_size").alias("text"), F.lit("Instant").alias("type_line"), F.lit(1.0).alias("cost"))
    items = part.unionByName(nations.select(F.concat(F.lit("n"), F.col("item").cast("string")).alias("item"), "name", F.lit("").alias("text"), F.lit("Land").alias("type_line"), F.lit(0.0).alias("cost")))
    said = {}

    def written(folder):
        said.update(probes.build(items, {"nations": named.withColumnsRenamed({"card_a": "name_a", "card_b": "name_b"})}, None, folder))

    def read(folder):
        rows = [spark.read.option("header", True).csv(f"{folder}/{name}.csv").select(F.lit(name).alias("file")) for name in ("identical_text", "nations")]
        missing = spark.createDataFrame([("missing",)] * len(said["nations"]["missing_names"]), "file string")
        return rows[0].unionByName(rows[1]).unionByName(missing).groupBy("file").agg(F.count("*").alias("n"))

    return through_files(spark, written, read)


@_query(f"SELECT 0.85::DOUBLE AS t0_pass, true AS part_exists, false AS lost_exists, 64 AS digest_length, 'x' AS asked, stratum, coverage FROM ({SQL['strata']})")
def findings_file(spark, d):
    """Findings of the strata with thresholds and the manifest of their inputs, read back from JSON."""
    rows = [r.asDict() for r in queries.strata(spark, d).select("stratum", "coverage").collect()]
    part, lost = f"{d}/nation.parquet", f"{d}/lost.parquet"

    def written(folder):
        gates.report(spark, folder, "found", {"strata": rows}, sinks.table(rows), [part, lost], {"asked": "x"})

    def read(folder):
        inputs = F.from_json(F.to_json("inputs"), "map<string, struct<exists: boolean, sha256: string>>")
        found = spark.read.option("multiLine", True).json(f"{folder}/found.json")
        at = lambda path: F.element_at(inputs, F.lit(path))
        told = [F.col("thresholds.t0.pass").alias("t0_pass"), at(part)["exists"].alias("part_exists"), at(lost)["exists"].alias("lost_exists"), F.length(at(part)["sha256"]).alias("digest_length"), F.col("run_args.asked").alias("asked")]
        return found.select(*told, F.explode("strata").alias("s")).select("*", "s.stratum", "s.coverage").drop("s")

    return through_files(spark, written, read)


@_query("SELECT CASE WHEN n_regionkey < 2 THEN '2a' ELSE '2b' END AS arm, n_name AS corpus, CASE WHEN n_regionkey < 2 THEN n_nationkey END AS n_total, CASE WHEN n_regionkey >= 2 THEN n_nationkey / 10 END AS lift FROM nation")
def merge_partial_files(spark, d):
    """Findings of two schemas, one of which has a number where the other has a text, as one table."""
    nation = _t(spark, d, "nation")
    first = nation.where("n_regionkey < 2").select(F.lit("2a").alias("arm"), F.col("n_name").alias("corpus"), F.col("n_nationkey").alias("n_total"), F.lit("none").alias("lift"))
    second = nation.where("n_regionkey >= 2").select(F.lit("2b").alias("arm"), F.col("n_name").alias("corpus"), (F.col("n_nationkey") / 10).alias("lift"))

    def written(folder):
        for rows in (first, second):
            rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("results"))).alias("value")).write.mode("append").text(folder)

    def read(folder):
        found = gates.partial_results(spark, folder, "*.txt")
        return found.select("arm", "corpus", F.try_variant_get("result", "$.n_total", "bigint").alias("n_total"), F.try_variant_get("result", "$.lift", "double").alias("lift"))

    return through_files(spark, written, read)
