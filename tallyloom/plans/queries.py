"""Registered queries over the star-schema tables, each with the SQL that must give the same rows.

Stand-ins: an order is a basket; its items are parts, suppliers, or return flags and brands. Statuses follow
from fixed rules. Floats are rounded to 6 places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import baskets as B
from ..operators import canonical, coverage, divergence, examples, names, pairs, similarity
from ..operators import cooccurrence as C
from . import gates

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in _needed(sql)) + sql if _needed(sql) else sql
        return f

    return register


def _needed(sql: str) -> list[str]:
    """The named tables that the SQL uses, with what they use, in order of definition."""
    import re

    wanted, grown = set(), {n for n in CTE if re.search(rf"\b{n}\b", sql)}
    while grown - wanted:
        wanted |= grown
        grown = {n for n in CTE for w in wanted if re.search(rf"\b{n}\b", CTE[w])}
    return [n for n in CTE if n in wanted]


#: Named tables of the SQL, in order of definition.
CTE = {
    "flag_baskets": "SELECT DISTINCT l_orderkey AS basket, item FROM (SELECT l_orderkey, l_returnflag AS item FROM lineitem UNION ALL SELECT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "part_baskets": "SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem",
    "supplier_baskets": "SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem",
    "flag_counts": "SELECT item, count(*) AS appearances FROM flag_baskets GROUP BY item",
    "part_counts": "SELECT item, count(*) AS appearances FROM part_baskets GROUP BY item",
    "flag_parsed": "SELECT DISTINCT item, CASE WHEN item = 'A' THEN 'Basic Land' ELSE 'Spell' END AS type_line, CASE WHEN length(item) = 1 THEN 'clean' WHEN right(item, 1) = '1' THEN 'gap' WHEN right(item, 1) = '2' THEN 'crash' WHEN right(item, 1) = '3' THEN 'excluded' ELSE 'clean' END AS status FROM flag_baskets WHERE item <> 'Brand#55'",
    "part_parsed": "SELECT p_partkey AS item, CASE WHEN p_size % 7 = 0 THEN 'Land' ELSE p_type END AS type_line, CASE p_size % 5 WHEN 0 THEN 'gap' WHEN 1 THEN 'excluded' WHEN 2 THEN 'crash' ELSE 'clean' END AS status, CASE WHEN p_size % 5 = 1 THEN 'reason ' || (p_size % 3) END AS exclusion_reason, CASE WHEN p_size % 5 = 0 THEN 'category ' || (p_size % 4) END AS gap_category FROM part",
    "flag_staples": "SELECT item FROM flag_counts WHERE appearances > 0.5 * (SELECT count(DISTINCT basket) FROM flag_baskets)",
    "flag_items": "SELECT p.*, status = 'clean' AS ok, coalesce(appearances, 0) AS appearances, p.item IN (SELECT item FROM flag_staples) AS staple, lower(type_line) LIKE '%land%' AS land FROM flag_parsed p LEFT JOIN flag_counts c ON p.item = c.item",
    "part_items": "SELECT p.*, status = 'clean' AS ok, coalesce(appearances, 0) AS appearances, appearances IS NOT NULL AS seen FROM part_parsed p LEFT JOIN part_counts c ON p.item = c.item",
    "supplier_pairs": "SELECT x.item AS a, y.item AS b, count(*) AS n FROM supplier_baskets x JOIN supplier_baskets y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2",
    "part_pairs": "SELECT x.item AS a, y.item AS b, count(*) AS n FROM part_baskets x JOIN part_baskets y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2",
    "supplier_sums": "SELECT item, sum(n) AS r FROM (SELECT a AS item, n FROM supplier_pairs UNION ALL SELECT b, n FROM supplier_pairs) GROUP BY item",
    "part_sums": "SELECT item, sum(n) AS r FROM (SELECT a AS item, n FROM part_pairs UNION ALL SELECT b, n FROM part_pairs) GROUP BY item",
    "supplier_ppmi": "SELECT a, b, n, ppmi FROM (SELECT a, b, n, ln(n::DOUBLE * (SELECT 2 * sum(n) FROM supplier_pairs)::DOUBLE) - ln(x.r::DOUBLE) - ln(y.r::DOUBLE) AS ppmi FROM supplier_pairs JOIN supplier_sums x ON a = x.item JOIN supplier_sums y ON b = y.item) WHERE ppmi > 0",
    "part_ppmi": "SELECT a, b, n, ppmi FROM (SELECT a, b, n, ln(n::DOUBLE * (SELECT 2 * sum(n) FROM part_pairs)::DOUBLE) - ln(x.r::DOUBLE) - ln(y.r::DOUBLE) AS ppmi FROM part_pairs JOIN part_sums x ON a = x.item JOIN part_sums y ON b = y.item) WHERE ppmi > 0",
    "supplier_eval": "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1 AND x.s_nationkey = y.s_nationkey",
    "supplier_positives": "SELECT a, b, ppmi FROM supplier_ppmi WHERE ppmi >= (SELECT quantile_cont(ppmi, 0.9) FROM (SELECT ppmi FROM supplier_ppmi UNION ALL SELECT ppmi FROM supplier_ppmi)) AND NOT EXISTS (SELECT 1 FROM supplier_eval e WHERE least(e.a, e.b) = supplier_ppmi.a AND greatest(e.a, e.b) = supplier_ppmi.b)",
    "page_items": "SELECT page_id AS item, 'page ' || page_id AS name, url AS text FROM pages",
    "doc_items": "SELECT doc_id AS item, 'doc ' || doc_id AS name, text FROM documents",
    "vector_pairs": "SELECT 'p' || v AS pair, a, b FROM (SELECT vec_id AS v, vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL",
    "group_members": "SELECT label AS grp, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1 AS place FROM embeddings",
    "group_sizes": "SELECT grp, count(*) AS size FROM group_members GROUP BY grp",
    "controls": "SELECT pair, anchor, partner FROM (SELECT pair, anchor, m.item AS partner, row_number() OVER (PARTITION BY pair, anchor ORDER BY step) AS k FROM (SELECT pair, a, b, anchor, h.grp, size, step, (('0x' || substr(md5('42:' || pair || ':' || anchor), 1, 8))::BIGINT + step * (1 + ('0x' || substr(md5('42:' || pair || ':' || anchor || ':stride'), 1, 8))::BIGINT % greatest(1, (size - 1) // 5))) % size AS place FROM (SELECT pair, a, b, unnest([a, b]) AS anchor FROM vector_pairs) JOIN group_members h ON anchor = h.item JOIN group_sizes s ON h.grp = s.grp, unnest(range(least(5, size))) AS r(step)) q JOIN group_members m ON q.grp = m.grp AND q.place = m.place WHERE m.item <> a AND m.item <> b) WHERE k <= 3",
    "side_cosines": "SELECT side, pair, a, b, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS cosine FROM (SELECT 'substitute' AS side, pair, a, b FROM vector_pairs UNION ALL SELECT 'random', pair, anchor, partner FROM controls) JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON b = y.vec_id",
    "name_items": "SELECT n_nationkey AS item, n_nationkey AS ordinal, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' // ' || r_name ELSE n_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "asked_names": "SELECT c_custkey // 10 AS basket, c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' // ' || r_name WHEN 2 THEN n_name || ' // elsewhere' WHEN 3 THEN 'no ' || n_name ELSE upper(n_name) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "exact_names": "SELECT lower(name) AS key, max_by(item, ordinal) AS item FROM name_items GROUP BY 1",
    "front_names": "SELECT split_part(lower(name), ' // ', 1) AS key, min_by(item, ordinal) AS item FROM name_items WHERE name LIKE '% // %' GROUP BY 1",
    "resolved_names": "SELECT basket, id, name, coalesce(e.item, f.item, g.item) AS item, CASE WHEN e.item IS NOT NULL THEN 'exact' WHEN f.item IS NOT NULL OR g.item IS NOT NULL THEN 'front' ELSE 'unresolved' END AS tier FROM asked_names LEFT JOIN exact_names e ON lower(name) = e.key LEFT JOIN front_names f ON lower(name) = f.key LEFT JOIN front_names g ON split_part(lower(name), ' // ', 1) = g.key",
    "scored_pairs": "SELECT o_orderpriority AS tier, o_orderkey % 3 > 0 AS both_clean, o_orderkey % 5 > 0 AS both_encoded, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 7 = 0 END AS diverge_rules_loose, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 14 = 0 END AS diverge_rules_strict, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 3 = 0 END AS diverge_full_loose FROM orders",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _flag_baskets(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    brands = lines.join(_t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return brands.select(F.col("l_orderkey").alias("basket"), F.explode(F.array("l_returnflag", "p_brand")).alias("item"))


def _baskets(spark, d, item):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col(item).alias("item"))


def _flag_parsed(spark, d):
    items = _flag_baskets(spark, d).select("item").distinct().where("item <> 'Brand#55'")
    last = F.right("item", F.lit(1))
    status = F.when(F.length("item") == 1, "clean").when(last == "1", "gap").when(last == "2", "crash").when(last == "3", "excluded").otherwise("clean")
    return items.select("item", F.when(F.col("item") == "A", "Basic Land").otherwise("Spell").alias("type_line"), status.alias("status"), (status == "clean").alias("ok"), status.isin("clean", "gap").alias("encoded"))


def _part_parsed(spark, d):
    size = F.col("p_size")
    status = F.when(size % 5 == 0, "gap").when(size % 5 == 1, "excluded").when(size % 5 == 2, "crash").otherwise("clean")
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("item"), F.when(size % 7 == 0, "Land").otherwise(F.col("p_type")).alias("type_line"), status.alias("status"), (status == "clean").alias("ok"), status.isin("clean", "gap").alias("encoded"),
        F.when(size % 5 == 1, F.concat(F.lit("reason "), (size % 3).cast("string"))).alias("exclusion_reason"), F.when(size % 5 == 0, F.concat(F.lit("category "), (size % 4).cast("string"))).alias("gap_category"),
    )


def _flag_items(spark, d):
    return coverage.weighed(_flag_parsed(spark, d), _flag_baskets(spark, d))


def _part_items(spark, d):
    return coverage.weighed(_part_parsed(spark, d), _baskets(spark, d, "l_partkey"))


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ── coverage ──


@_query("SELECT item, appearances FROM flag_counts")
def appearance_counts(spark, d):
    return B.appearance_counts(_flag_baskets(spark, d))


@_query("SELECT item, appearances FROM flag_counts WHERE item IN (SELECT item FROM flag_staples)")
def staples(spark, d):
    return B.staples(_flag_baskets(spark, d))


@_query("SELECT coalesce(sum(appearances) FILTER (ok), 0)::BIGINT AS covered, sum(appearances)::BIGINT AS total, round(coalesce(sum(appearances) FILTER (ok), 0)::DOUBLE / sum(appearances)::DOUBLE, 6) AS coverage FROM flag_items")
def weighted_coverage(spark, d):
    return _six(coverage.weighted_coverage(_flag_items(spark, d)), "coverage")


_STRATA = " UNION ALL ".join(f"SELECT '{k}' AS stratum, coalesce(sum(appearances) FILTER (ok AND {c}), 0)::BIGINT AS covered, coalesce(sum(appearances) FILTER ({c}), 0)::BIGINT AS total FROM flag_items" for k, c in (("all", "true"), ("non_land", "NOT land"), ("non_staple", "NOT staple"), ("non_land_non_staple", "NOT land AND NOT staple")))


@_query(f"SELECT *, round(coalesce(covered::DOUBLE / nullif(total, 0)::DOUBLE, 0), 6) AS coverage FROM ({_STRATA})")
def strata(spark, d):
    return _six(coverage.strata(_flag_items(spark, d)), "coverage")


@_query("SELECT count(*) AS items, coalesce(sum(appearances), 0)::BIGINT AS appearances FROM flag_counts WHERE item NOT IN (SELECT item FROM flag_parsed)")
def unmatched_appearances(spark, d):
    return coverage.unmatched(_flag_parsed(spark, d), _flag_baskets(spark, d))


@_query("SELECT head, round(coalesce(sum(appearances) FILTER (ok), 0)::DOUBLE / sum(appearances)::DOUBLE, 6) AS appearance_coverage, round(avg(ok::INT), 6) AS distinct_coverage, count(*) AS n_items FROM (SELECT item, row_number() OVER (ORDER BY appearances DESC, item) AS place FROM part_counts) JOIN part_items USING (item), (VALUES (100), (500), (2000)) v(head) WHERE place <= head GROUP BY head")
def head_breakouts(spark, d):
    return _six(coverage.head_breakouts(_part_items(spark, d), _baskets(spark, d, "l_partkey")), "appearance_coverage", "distinct_coverage")


@_query("SELECT s.status, coalesce(sum(appearances), 0)::BIGINT AS appearances, round(coalesce(sum(appearances), 0)::DOUBLE / (SELECT sum(appearances) FROM part_items)::DOUBLE, 6) AS share, count(*) FILTER (seen) AS n_items FROM (VALUES ('clean'), ('gap'), ('crash'), ('excluded')) s(status) LEFT JOIN part_items p ON p.status = s.status GROUP BY s.status")
def status_share(spark, d):
    return _six(coverage.status_share(_part_items(spark, d)), "share")


@_query("SELECT exclusion_reason, sum(appearances)::BIGINT AS appearances FROM part_items WHERE status = 'excluded' AND exclusion_reason IS NOT NULL GROUP BY 1")
def exclusion_reasons(spark, d):
    return coverage.exclusion_reasons(_part_items(spark, d))


@_query("SELECT gap_category, sum(appearances)::BIGINT AS appearances FROM part_items WHERE status = 'gap' AND gap_category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def gap_categories(spark, d):
    return coverage.gap_categories(_part_items(spark, d))


@_query("SELECT item, status, appearances FROM part_items WHERE NOT ok ORDER BY appearances DESC, item LIMIT 200")
def failures_topk(spark, d):
    return coverage.failures(_part_items(spark, d)).select("item", "status", "appearances")


@_query("SELECT round(avg(ok::INT), 6) AS all_items, round(avg(ok::INT) FILTER (seen), 6) AS in_baskets FROM part_items")
def distinct_coverage(spark, d):
    return _six(coverage.distinct_coverage(_part_items(spark, d)), "all_items", "in_baskets")


@_query("SELECT l.doc_id IS NOT NULL AS labelled, CASE WHEN l.doc_id IS NULL THEN 'excluded' WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'clean' ELSE 'gap' END AS status, CASE WHEN l.doc_id IS NULL THEN 'not in snapshot' WHEN toxic = 1 THEN 'toxic' END AS exclusion_reason, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2, 3")
def parsed_statuses(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("item"))
    toxic = F.col("toxic") == 1
    known = _t(spark, d, "labels").select(F.col("doc_id").alias("item"), F.when(toxic, "excluded").when(F.col("quality") == 1, "clean").otherwise("gap").alias("status"), F.when(toxic, "toxic").alias("exclusion_reason"), F.lit(True).alias("labelled"))
    return coverage.with_status(docs, known).groupBy(F.coalesce("labelled", F.lit(False)).alias("labelled"), "status", "exclusion_reason").agg(F.count("*").alias("n"))


@_query(f"SELECT round(coverage, 6) AS coverage, round(guarded, 6) AS guarded, CASE WHEN coverage < 0.70 THEN 'FAIL' WHEN coverage >= 0.85 AND coverage - guarded <= 0.10 THEN 'PASS' ELSE 'UNRESOLVED' END AS verdict FROM (SELECT max(c) FILTER (stratum = 'all') AS coverage, max(c) FILTER (stratum = 'non_land_non_staple') AS guarded FROM (SELECT stratum, coalesce(covered::DOUBLE / nullif(total, 0)::DOUBLE, 0) AS c FROM ({_STRATA})))")
def verdict_t0(spark, d):
    return _six(coverage.judged(_flag_items(spark, d)), "coverage", "guarded")


# ── co-occurrence ──


@_query("SELECT a, b, n FROM supplier_pairs")
def cooccurrence(spark, d):
    return C.cooccurrence(_baskets(spark, d, "l_suppkey"))


@_query("SELECT a, b, n, round(ppmi, 6) AS ppmi FROM part_ppmi")
def ppmi_sparse(spark, d):
    return _six(C.ppmi(C.cooccurrence(_baskets(spark, d, "l_partkey"))), "ppmi")


@_query("SELECT a, b, n, round(ppmi, 6) AS ppmi FROM supplier_ppmi")
def ppmi_dense(spark, d):
    return _six(_supplier_ppmi(spark, d), "ppmi")


def _supplier_ppmi(spark, d):
    return C.ppmi(C.cooccurrence(_baskets(spark, d, "l_suppkey")))


def _supplier_eval(spark, d):
    own = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), "s_nationkey")
    return own.join(own.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), "s_nationkey"), ["a", "s_nationkey"]).select("a", "b")


def _supplier_positives(spark, d, strict=False):
    return C.positives(_supplier_ppmi(spark, d), _supplier_eval(spark, d), strict=strict)


@_query("SELECT a, b, round(ppmi, 6) AS ppmi FROM supplier_positives")
def positives_pair_only(spark, d):
    return _six(_supplier_positives(spark, d), "ppmi").select("a", "b", "ppmi")


@_query("SELECT a, b, round(ppmi, 6) AS ppmi FROM supplier_positives WHERE a NOT IN (SELECT a FROM supplier_eval UNION ALL SELECT b FROM supplier_eval) AND b NOT IN (SELECT a FROM supplier_eval UNION ALL SELECT b FROM supplier_eval)")
def positives_strict(spark, d):
    return _six(_supplier_positives(spark, d, strict=True), "ppmi").select("a", "b", "ppmi")


@_query("SELECT a, b FROM supplier_positives ORDER BY md5('42:' || a || ':' || b), a, b LIMIT 50")
def cap_positives(spark, d):
    return C.cap(_supplier_positives(spark, d), 50).select("a", "b")


@_query("SELECT a, b, CASE WHEN row_number() OVER (ORDER BY md5('42:' || a || ':' || b)) <= greatest(1, floor(0.15 * (SELECT count(*) FROM supplier_positives))) THEN 'holdout' ELSE 'train' END AS split FROM supplier_positives")
def holdout_split(spark, d):
    return C.holdout(_supplier_positives(spark, d)).select("a", "b", "split")


_COLOURED = "SELECT s_nationkey AS colour, s_suppkey AS item, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('42:' || s_nationkey || ':' || s_suppkey), s_suppkey) - 1 AS place, count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier WHERE s_suppkey IN (SELECT item FROM supplier_baskets)"


@_query(f"""SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY md5('42:' || a), a) AS k FROM (
  SELECT x.a, min_by(y.item, (y.place - x.first + x.size) % x.size) AS b
  FROM (SELECT item AS a, colour, size, ('0x' || substr(md5('42:' || item || ':' || colour), 1, 8))::BIGINT % size AS first FROM ({_COLOURED}) ORDER BY md5('42:' || item), item LIMIT 4000) x
  JOIN ({_COLOURED}) y ON y.colour = x.colour AND y.item <> x.a
  WHERE NOT EXISTS (SELECT 1 FROM supplier_ppmi p WHERE p.a = least(x.a, y.item) AND p.b = greatest(x.a, y.item))
    AND NOT EXISTS (SELECT 1 FROM supplier_eval e WHERE least(e.a, e.b) = least(x.a, y.item) AND greatest(e.a, e.b) = greatest(x.a, y.item))
  GROUP BY x.a)) WHERE k = 1""")
def hard_negatives(spark, d):
    colours = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), F.array(F.col("s_nationkey").cast("string")).alias("colours"))
    vocabulary = _baskets(spark, d, "l_suppkey").select("item").distinct()
    values, asked = _supplier_ppmi(spark, d), _supplier_eval(spark, d)
    return C.hard_negatives(values, colours, vocabulary, asked, C.positives(values, asked))


_TOUCHED = "SELECT a FROM supplier_eval UNION ALL SELECT b FROM supplier_eval"


@_query(f"SELECT * FROM ({SQL['hard_negatives']}) WHERE a NOT IN ({_TOUCHED}) AND b NOT IN ({_TOUCHED})")
def hard_negatives_strict(spark, d):
    return C.strict_ones(hard_negatives(spark, d), _supplier_eval(spark, d)).select("a", "b")


_PHENOTYPE = "SELECT a, b, round(ppmi, 6) AS ppmi, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS cosine FROM (SELECT a, b, ppmi FROM supplier_ppmi ORDER BY md5('42:' || a || ':' || b), a, b LIMIT 20000) s JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON b = y.vec_id WHERE NOT EXISTS (SELECT 1 FROM supplier_eval e WHERE least(e.a, e.b) = s.a AND greatest(e.a, e.b) = s.b)"


@_query(f"SELECT * FROM (SELECT *, 'positive' AS kind FROM ({_PHENOTYPE}) ORDER BY ppmi DESC, cosine, a, b LIMIT 300) UNION ALL SELECT * FROM (SELECT *, 'negative' AS kind FROM ({_PHENOTYPE}) ORDER BY ppmi, cosine DESC, a, b LIMIT 300)")
def phenotype_pairs(spark, d):
    return C.phenotype_pairs(_supplier_ppmi(spark, d), _vectors(spark, d), _supplier_eval(spark, d))


@_query(f"SELECT * FROM ({SQL['phenotype_pairs']}) WHERE a NOT IN ({_TOUCHED}) AND b NOT IN ({_TOUCHED})")
def phenotype_pairs_strict(spark, d):
    found = phenotype_pairs(spark, d)
    return C.strict_ones(found, _supplier_eval(spark, d)).select(found.columns)


# ── splits ──


@_query("SELECT basket, CASE WHEN row_number() OVER (ORDER BY md5('42:' || basket)) <= greatest(1, round_even(count(*) OVER () * 0.15::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT l_orderkey AS basket FROM lineitem)")
def deck_split(spark, d):
    return B.split_baskets(_baskets(spark, d, "l_partkey"))


@_query("""SELECT basket, created_at, cutoff, CASE WHEN created_at < cutoff THEN 'train' ELSE 'test' END AS split FROM (
  SELECT *, (SELECT created_at FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS created_at, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC) AS k FROM orders WHERE o_orderkey % 10 > 0) WHERE k = (SELECT greatest(1, round_even(count(*) * 0.15::DOUBLE, 0)) FROM orders WHERE o_orderkey % 10 > 0)) AS cutoff
  FROM (SELECT o_orderkey AS basket, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderkey % 10 > 0))""")
def temporal_split(spark, d):
    dated = _t(spark, d, "orders").select(F.col("o_orderkey").alias("basket"), F.when(F.col("o_orderkey") % 10 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created_at"))
    return B.temporal_split(dated)


# ── pairs ──


@_query("""SELECT a, b, substr(template, 1, 120) AS template FROM (SELECT x.template, x.item AS a, y.item AS b, row_number() OVER (PARTITION BY x.template ORDER BY x.name, x.item, y.name, y.item) AS k
  FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS template FROM page_items WHERE regexp_matches(text, '[0-9]')) x
  JOIN (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS template FROM page_items WHERE regexp_matches(text, '[0-9]')) y
  ON x.template = y.template AND (x.name < y.name OR (x.name = y.name AND x.item < y.item)) AND trim(x.text) <> trim(y.text) WHERE length(x.template) > 12) WHERE k <= 3""")
def numeric_pairs(spark, d):
    return pairs.numeric_pairs(_t(spark, d, "pages").select(F.col("page_id").alias("item"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("text")))


@_query("""SELECT a, b, substr(masked, 1, 100) AS note FROM (SELECT masked, name, item AS a, lead(item) OVER (PARTITION BY masked ORDER BY name, item) AS b FROM (
  SELECT item, name, replace(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), lower(name), '~') AS masked FROM doc_items WHERE text IS NOT NULL AND regexp_replace(text, '[ \t\r\n]+', '', 'g') <> '') WHERE length(masked) > 20)
WHERE b IS NOT NULL ORDER BY masked, name, a LIMIT 800""")
def identical_text_pairs(spark, d):
    return pairs.identical_text_pairs(_t(spark, d, "documents").select(F.col("doc_id").alias("item"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), "text"))


_TAGS = "SELECT p_brand || '-' || (p_size % 25) AS slug, p_partkey AS item FROM part"


@_query(f"""SELECT a, b, slug, n FROM (SELECT x.item AS a, y.item AS b, min_by(z.slug, (z.n, z.slug)) AS slug, min(z.n) AS n FROM
  (SELECT slug, count(*) AS n FROM ({_TAGS}) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40) z JOIN ({_TAGS}) x ON x.slug = z.slug JOIN ({_TAGS}) y ON y.slug = z.slug AND x.item < y.item
  JOIN part p ON p.p_partkey = x.item JOIN part q ON q.p_partkey = y.item AND p.p_partkey % 4 = q.p_partkey % 4 WHERE abs(p.p_size - q.p_size) <= 1 GROUP BY 1, 2) ORDER BY n, slug, a, b LIMIT 400""")
def tag_candidates(spark, d):
    part = _t(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "Legendary Creature — Elf").when(F.col("p_partkey") % 4 == 1, "Instant").when(F.col("p_partkey") % 4 == 2, "Artifact").otherwise("Basic Land")
    items = part.select(F.col("p_partkey").alias("item"), kind.alias("type_line"), F.col("p_size").alias("cost"))
    slugs = part.select(F.concat_ws("-", "p_brand", (F.col("p_size") % 25).cast("string")).alias("slug"), F.col("p_partkey").alias("item"))
    return pairs.tag_candidates(items, pairs.tag_index(slugs))


@_query("SELECT name, item, tier FROM resolved_names")
def name_resolution(spark, d):
    return _resolved(spark, d).select("name", "item", "tier")


@_query("SELECT count(DISTINCT basket) AS n_baskets, count(DISTINCT basket) FILTER (tier <> 'unresolved') AS n_baskets_resolved, count(*) AS n_names, count(*) FILTER (tier = 'exact') AS n_exact, count(*) FILTER (tier = 'front') AS n_front, count(*) FILTER (tier = 'unresolved') AS n_unresolved, round(count(*) FILTER (tier <> 'unresolved')::DOUBLE / count(*), 6) AS resolution_rate, (SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT DISTINCT name FROM resolved_names WHERE tier = 'unresolved' ORDER BY name LIMIT 50)) AS unresolved_examples FROM resolved_names")
def resolution_stats(spark, d):
    return _six(names.resolution_stats(_resolved(spark, d)), "resolution_rate")


def _resolved(spark, d):
    nation = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = nation.select(F.col("n_nationkey").alias("item"), F.col("n_nationkey").alias("ordinal"), F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(" // ", "n_name", "r_name")).otherwise(F.col("n_name")).alias("name"))
    kind, n = F.col("c_custkey") % 5, F.col("n_name")
    asked = F.when(kind == 0, n).when(kind == 1, F.concat_ws(" // ", F.lower(n), "r_name")).when(kind == 2, F.concat(n, F.lit(" // elsewhere"))).when(kind == 3, F.concat(F.lit("no "), n)).otherwise(F.upper(n))
    rows = _t(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.expr("c_custkey div 10").alias("basket"), F.col("c_custkey").alias("id"), asked.alias("name"))
    return names.resolve(rows, items)


_PTYPE = "CASE p_partkey % 4 WHEN 0 THEN 'creature' WHEN 1 THEN 'instant' WHEN 2 THEN 'artifact' ELSE 'other' END"


def _typed_parts(spark, d):
    kind = F.when(F.col("p_partkey") % 4 == 0, "Legendary Creature — Land").when(F.col("p_partkey") % 4 == 1, "Instant").when(F.col("p_partkey") % 4 == 2, "Artifact").otherwise("Token — Creature")
    return _t(spark, d, "part").withColumn("type_line", kind)


@_query(f"SELECT p_partkey AS item, {_PTYPE} AS primary_type FROM part")
def primary_type(spark, d):
    return _typed_parts(spark, d).select(F.col("p_partkey").alias("item"), text.primary_type("type_line").alias("primary_type"))


@_query(f"SELECT p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN 'C' ELSE least(p_brand, 'W') || greatest(p_brand, 'W') END || '|' || CASE WHEN p_size <= 1 THEN '0-1' WHEN p_size <= 3 THEN '2-3' WHEN p_size <= 5 THEN '4-5' ELSE '6+' END || '|' || {_PTYPE} AS stratum FROM part")
def stratum_key(spark, d):
    colours = F.when(F.col("p_partkey") % 3 > 0, F.array(F.lit("W"), "p_brand"))
    return _typed_parts(spark, d).withColumn("colours", colours).select(F.col("p_partkey").alias("item"), text.stratum("colours", "p_size", "type_line").alias("stratum"))


@_query("SELECT p_partkey AS item, regexp_replace(p_name, '\\b[0-9]+\\b', 'N', 'g') AS masked, CASE WHEN p_size % 2 = 0 THEN p_type || ' [SEP] ' || p_name ELSE p_name END AS item_text, lower(trim(regexp_replace(p_name, '[0-9]+', '#', 'g'))) AS template, replace(lower(p_name), lower(p_brand), '~') AS name_masked FROM part")
def text_expressions(spark, d):
    typed = _t(spark, d, "part").withColumn("t", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("")))
    return typed.select(F.col("p_partkey").alias("item"), text.numbers_masked("p_name").alias("masked"), text.item_text("t", "p_name").alias("item_text"), text.number_template("p_name").alias("template"), text.name_masked("p_name", "p_brand").alias("name_masked"))


# ── similarity ──


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


def _groups(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("grp"))


def _vector_pairs(spark, d):
    from pyspark.sql import Window

    following = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("a"), following.alias("b")).where("b is not null")
    return rows.select(F.concat(F.lit("p"), F.col("a").cast("string")).alias("pair"), "a", "b")


@_query("SELECT pair, a, b, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS cosine FROM vector_pairs JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON b = y.vec_id")
def pair_cosine(spark, d):
    return _six(vectors.pair_cosines(_vector_pairs(spark, d), _vectors(spark, d)), "cosine")


@_query("SELECT pair, anchor, partner FROM controls")
def random_controls(spark, d):
    return similarity.random_controls(_vector_pairs(spark, d), _groups(spark, d))


def _side_cosines(spark, d):
    return similarity.substitute_and_control(_vector_pairs(spark, d), _vectors(spark, d), _groups(spark, d))


@_query("SELECT count(*) FILTER (side = 'substitute') AS n_substitute, count(*) FILTER (side = 'random') AS n_random, round(avg(cosine) FILTER (side = 'substitute'), 6) AS mean_substitute, round(avg(cosine) FILTER (side = 'random'), 6) AS mean_random, round(avg(cosine) FILTER (side = 'substitute') - avg(cosine) FILTER (side = 'random'), 6) AS lift FROM side_cosines")
def lift(spark, d):
    return _six(similarity.lift(_side_cosines(spark, d)), "mean_substitute", "mean_random", "lift")


def _bootstrap_sql(cosines: str, seed: int, replicates: int = similarity.REPLICATES) -> str:
    """(lift, ci_low, ci_high) over a table of cosines, by the weights that the operator draws."""
    number = lambda at: f"('0x' || substr(md5('{seed}:' || side || ':' || pair || ':' || a || ':' || b), {at}, 8))::BIGINT % {similarity.PRIME}"
    weight = " + ".join(f"(u >= {c})::BIGINT" for c in similarity.CUTS)
    mean = lambda side: f"sum(w * cosine) FILTER (side = '{side}') / nullif(sum(w) FILTER (side = '{side}'), 0)"
    lifts = f"SELECT {mean('substitute')} - {mean('random')} AS lift FROM (SELECT side, cosine, r, {weight} AS w FROM (SELECT side, cosine, r, (x * r + y) % {similarity.PRIME} AS u FROM (SELECT side, cosine, {number(1)} AS x, {number(9)} AS y FROM {cosines}), unnest(range({replicates})) AS t(r))) GROUP BY r"
    return f"SELECT (SELECT avg(cosine) FILTER (side = 'substitute') - avg(cosine) FILTER (side = 'random') FROM {cosines}) AS lift, quantile_cont(lift, 0.025) AS ci_low, quantile_cont(lift, 0.975) AS ci_high FROM ({lifts})"


@_query(f"SELECT round(lift, 6) AS lift, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ({_bootstrap_sql('side_cosines', 42)})")
def bootstrap_ci(spark, d):
    return _six(similarity.bootstrap(_side_cosines(spark, d)), "lift", "ci_low", "ci_high")


# ── examples, divergence, verdicts ──


@_query("""SELECT p.ordinal, ta.text AS anchor, tb.text AS positive, tn.text AS negative FROM (SELECT o_orderkey AS ordinal, o_custkey AS a, (o_custkey + 7) % 1000 + 1 AS b FROM orders) p
  LEFT JOIN (SELECT a, min_by(b, ordinal) AS own FROM (SELECT s_suppkey - 1 AS ordinal, s_suppkey * 3 AS a, s_suppkey AS b FROM supplier) GROUP BY a) o ON o.a = p.a
  LEFT JOIN (SELECT s_suppkey - 1 AS slot, s_suppkey AS spare FROM supplier) s ON s.slot = p.ordinal % (SELECT count(*) FROM supplier)
  JOIN (SELECT p_partkey AS item, p_name AS text FROM part WHERE p_size > 3) ta ON ta.item = p.a JOIN (SELECT p_partkey AS item, p_name AS text FROM part WHERE p_size > 3) tb ON tb.item = p.b JOIN (SELECT p_partkey AS item, p_name AS text FROM part WHERE p_size > 3) tn ON tn.item = coalesce(own, spare)""")
def training_examples(spark, d):
    mined = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("a"), ((F.col("o_custkey") + 7) % 1000 + 1).alias("b"))
    negatives = _t(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("ordinal"), (F.col("s_suppkey") * 3).alias("a"), F.col("s_suppkey").alias("b"))
    texts = _t(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 3, F.col("p_name")).otherwise(F.lit("")).alias("text"))
    return examples.training_examples(mined, negatives, texts)


def _scored(spark, d):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    encoded = key % 5 > 0
    return _t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("tier"), (key % 3 > 0).alias("both_clean"), encoded.alias("both_encoded"),
        F.when(encoded, customer % 7 == 0).alias("diverge_rules_loose"), F.when(encoded, customer % 14 == 0).alias("diverge_rules_strict"), F.when(encoded, customer % 3 == 0).alias("diverge_full_loose"),
    )


@_query("SELECT tier, count(*) AS n_pairs, count(*) FILTER (both_clean) AS n_both_clean, count(*) FILTER (both_encoded) AS n_both_encoded, round(avg(diverge_rules_loose::INT) FILTER (both_clean), 6) AS clean_rules_loose, round(avg(diverge_rules_strict::INT) FILTER (both_clean), 6) AS clean_rules_strict, round(avg(diverge_full_loose::INT) FILTER (both_clean), 6) AS clean_full_loose, round(avg(diverge_rules_loose::INT) FILTER (both_encoded), 6) AS all_rules_loose FROM scored_pairs GROUP BY tier")
def divergence_rates(spark, d):
    return _six(divergence.rates(_scored(spark, d), "tier"), "clean_rules_loose", "clean_rules_strict", "clean_full_loose", "all_rules_loose").drop("upper_bound", "underpowered")


@_query("SELECT k % 3 AS seen, k AS n, CASE WHEN k % 3 = 0 AND k > 0 THEN round(3.0::DOUBLE / k, 6) END AS upper_bound, k < 20 AS underpowered FROM (SELECT n_nationkey AS k FROM nation)")
def rule_of_three(spark, d):
    rows = _t(spark, d, "nation").select((F.col("n_nationkey") % 3).alias("seen"), F.col("n_nationkey").alias("n"))
    return rows.select("seen", "n", F.round(divergence.upper_bound(F.col("seen"), F.col("n")), 6).alias("upper_bound"), (F.col("n") < divergence.ENOUGH).alias("underpowered"))


@_query("SELECT p_partkey AS id, CASE WHEN x > 0.25 THEN 'FAIL' WHEN x >= 0.10 THEN 'PARTIAL' WHEN coalesce(y, 0) >= 0.05 THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM (SELECT p_partkey, (p_partkey % 40)::DOUBLE / 100 AS x, CASE WHEN p_size % 3 > 0 THEN (p_size % 10)::DOUBLE / 100 END AS y FROM part)")
def verdict_t1(spark, d):
    y = F.when(F.col("p_size") % 3 > 0, (F.col("p_size") % 10).cast("double") / 100)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), divergence.verdict((F.col("p_partkey") % 40).cast("double") / 100, y).alias("verdict"))


@_query("SELECT p_partkey AS id, CASE WHEN l IS NULL THEN 'NO_DATA' WHEN l < 0.05 OR c <= 0 THEN 'FAIL' WHEN m > 0 AND l < 0.5 * m THEN 'PHENOTYPE_FIT' ELSE 'PASS' END AS verdict, coalesce(m < 0.05 AND m < 0.5 * l, false) AS narrow FROM (SELECT p_partkey, CASE WHEN p_size > 2 THEN (p_partkey % 30)::DOUBLE / 100 END AS l, (p_partkey % 7)::DOUBLE / 100 AS c, CASE WHEN p_size % 3 > 0 THEN (p_size % 40)::DOUBLE / 50 END AS m FROM part)")
def verdict_t2(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    one, m = F.when(size > 2, (key % 30).cast("double") / 100), F.when(size % 3 > 0, (size % 40).cast("double") / 50)
    return _t(spark, d, "part").select(key.alias("id"), similarity.verdict(one, (key % 7).cast("double") / 100, m).alias("verdict"), similarity.narrow_effect(one, m).alias("narrow"))


@_query("SELECT CASE WHEN n_regionkey < 2 THEN '2a' ELSE '2b' END AS arm, n_name AS corpus, CASE WHEN n_regionkey >= 2 THEN n_nationkey END AS n_total FROM nation")
def merge_partials(spark, d):
    nation = _t(spark, d, "nation")
    first = nation.where("n_regionkey < 2").select(F.lit("2a").alias("arm"), F.col("n_name").alias("corpus"))
    return gates.merge_results([first, nation.where("n_regionkey >= 2").select(F.lit("2b").alias("arm"), F.col("n_name").alias("corpus"), F.col("n_nationkey").alias("n_total"))])


def _encodings(spark, d):
    part = _t(spark, d, "part")
    body = F.format_string('CARD {\n  NAME: "%s"\n  TYPES: ["%s"]\n%s  SPELL {\n    FILTER { AND { TYPE: "Basic" SIZE: %d } }\n    EFFECT: [\n      SEARCH { ZONE: YOU } AS $x%d;\n      MOVE { $x%d TO: HAND }\n    ]\n  }\n}', "p_name", "p_type", F.when(F.col("p_size") % 6 == 0, "  # SPEC_GAP: size: unknown\n").otherwise(F.lit("")), F.expr("p_size div 10"), "p_partkey", "p_partkey")
    rows = part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), body.alias("cdl"), F.lit(None).cast("string").alias("error"), F.when(F.col("p_size") % 11 == 0, "size").alias("exclusion_reason"))
    return divergence.with_markers(rows)


@_query("SELECT p_partkey AS item, CASE WHEN p_size % 11 = 0 THEN 'excluded' WHEN p_size % 6 = 0 THEN 'gap' ELSE 'clean' END AS status, CASE WHEN p_size % 11 > 0 AND p_size % 6 = 0 THEN 'size' END AS gap_category, CASE WHEN p_size % 11 > 0 AND p_size % 6 = 0 THEN 1 ELSE 0 END AS n_gaps FROM part")
def marker_statuses(spark, d):
    return _encodings(spark, d).select("item", "status", "gap_category", "n_gaps")


@_query("SELECT p_partkey AS item, 'CARD{SPELL{FILTER{AND{SIZE: ' || (p_size // 10) || ';TYPE: \"Basic\"}};EFFECT:{SEARCH{ZONE: YOU};AS $0;MOVE{$0;TO: HAND}}}}' AS form FROM part")
def canonical_forms(spark, d):
    return _encodings(spark, d).select("item", canonical.canonical_column("cdl", "name").alias("form"))


@_query("SELECT count(*) AS n_pairs, count(*) FILTER (c) AS n_both_clean, count(*) FILTER (e) AS n_both_encoded, round(avg(x::INT) FILTER (c), 6) AS clean_rules_loose, round(avg(y::INT) FILTER (c), 6) AS clean_full_loose FROM (SELECT p.p_size % 11 > 0 AND q.p_size % 11 > 0 AND p.p_size % 6 > 0 AND q.p_size % 6 > 0 AS c, p.p_size % 11 > 0 AND q.p_size % 11 > 0 AS e, p.p_size // 10 <> q.p_size // 10 AS x, p.p_size // 10 <> q.p_size // 10 OR p.p_type <> q.p_type AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)")
def scored_divergence(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("a"))
    near = part.select("a", (F.col("a") + 1).alias("b")).join(part.withColumnRenamed("a", "b"), "b", "left_semi")
    scored = divergence.score_pairs(near, _encodings(spark, d))
    return _six(divergence.rates(scored), "clean_rules_loose", "clean_full_loose").select("n_pairs", "n_both_clean", "n_both_encoded", "clean_rules_loose", "clean_full_loose")


@_query("SELECT event_type AS item, count(DISTINCT user_id) AS appearances FROM events GROUP BY event_type")
def event_appearances(spark, d):
    return B.appearance_counts(_t(spark, d, "events").select(F.col("user_id").alias("basket"), F.col("event_type").alias("item")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Appearance-weighted coverage by stratum, with the verdict."""
    items = _flag_items(spark, d)
    return coverage.strata(items).withColumn("verdict", coverage.judged(items).select("verdict").scalar())


from . import gate_queries, source_queries  # noqa: E402,F401  they register their queries
