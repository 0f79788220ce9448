"""The corpus operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import collocations, conversations, decontam, mixing, quantised, secrets, sharding, simhash, substrings, tokens, toxicity, urls, warc
from .common import table


def op1_warc_derivatives(spark, sf_dir):
    return warc.through_files(warc.responses(table(spark, sf_dir, "pages")), carry="page_id").withColumn("block", F.col("block").cast("string"))


def op2_product_quantised_dedup(spark, sf_dir):
    return quantised.embedding_groups(table(spark, sf_dir, "embeddings"))


def op3_minimax_shards(spark, sf_dir):
    return sharding.minimax_shards(table(spark, sf_dir, "documents"))


def op4_bucket_pointer_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op5_winnowing_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark, sf_dir, tokenizer=None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokens.token_table(table(spark, sf_dir, "documents"), tokenizer)


def op7_cube_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_simhash_variants(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_url_rules(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op10_ordinal_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    repaired = conversations.repaired_digests(conversations.damage(rows), rows.select(F.col("conv_id").alias("conv")))
    return repaired.withColumnRenamed("conv", "conv_id")


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_linked_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def product_quantised_wide(spark, sf_dir):
    """The operator of op2 at a cosine that small tables reach, all lists within the bound probed."""
    return quantised.embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.4, deviations=None)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_product_quantised_dedup, op3_minimax_shards, op4_bucket_pointer_dedup, op5_winnowing_decontamination, op6_token_files, op7_cube_mixing,
        op8_simhash_variants, op9_url_rules, op10_ordinal_toxicity, op11_conversation_repair, op12_collocations, op13_linked_secrets, product_quantised_wide,
    )
}

ORACLE_SQL = {}

ORACLE_SQL["op9_url_rules"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#/]*') AS raw, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS whole FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(whole, length(raw) + 1) AS path FROM split),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)), 'allow') AS verdict
FROM urls
"""

ORACLE_SQL["op5_winnowing_decontamination"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
  FROM item_words, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM doc_words, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows b ON p.n = b.n AND p.words = b.words),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(n)) AS r(k) GROUP BY doc_id),
matched AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN matched USING (doc_id)
"""


def _embedding_sql(cosine: float) -> str:
    product = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding, sqrt({product('embedding', 'embedding')}) AS norm FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.embedding) = len(y.embedding)
  WHERE {product('x.embedding', 'y.embedding')} / (x.norm * y.norm) >= {cosine}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings LEFT JOIN least l ON vec_id = l.a LEFT JOIN counts c ON vec_id = c.a
"""


ORACLE_SQL["op2_product_quantised_dedup"] = _embedding_sql(0.98)
ORACLE_SQL["product_quantised_wide"] = _embedding_sql(0.4)

ORACLE_SQL["op4_bucket_pointer_dedup"] = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM texts, unnest(range(length(h) // 2 - 49)) AS r(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
hits AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE first < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hits),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

#: crc32 of a string's bytes: a step for each byte, and eight in it.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode({k})) + 1, 2), lambda i: ('0x' || substr(hex(encode({k})), i, 2))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLE_SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {_CRC32.format(k="k")} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS two FROM placed),
moves(letter, f, t, pre) AS (VALUES ('s', '0', 'S', ''), ('u', '0', 'U', ''), ('u', 'S', 'U', ''), ('u', 'A', 'U', ''), ('u', 'U', 'U', 'I'), ('a', 'U', 'A', ''), ('a', '0', 'A', 'I'), ('a', 'S', 'A', 'I'), ('a', 'A', 'A', 'I')),
edits(edit, letter, cost) AS (VALUES ('K', 's', 0), ('K', 'u', 0), ('K', 'a', 0), ('R', 'u', 1), ('R', 'a', 1)),
steps AS (
  SELECT conv_id, pos, f, f AS t, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS made FROM faults, (VALUES ('0'), ('S'), ('U'), ('A')) AS v(f)
  UNION ALL
  SELECT conv_id, pos, f, t, 5 * length(pre) + cost + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, pre || edit,
    (CASE WHEN pre = '' THEN []::VARCHAR[] WHEN f = 'U' THEN ['assistant:'] ELSE ['user:'] END) || [CASE WHEN edit = 'K' THEN role WHEN moves.letter = 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM faults JOIN edits ON edit = 'R' OR edits.letter = substr(role, 1, 1) JOIN moves USING (letter) WHERE fault NOT IN ('blank', 'duplicate')),
walk(conv_id, pos, state, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0', {{'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT conv_id, pos, t, min(b) FROM (
    SELECT w.conv_id, w.pos + 1 AS pos, s.t, {{'cost': w.b.cost + s.cost, 'audit': w.b.audit || s.audit, 'made': w.b.made || s.made}} AS b
    FROM walk w JOIN steps s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = w.pos + 1 AND s.f = w.state) GROUP BY conv_id, pos, t),
ended AS (
  SELECT conv_id, pos, {{'cost': b.cost + CASE state WHEN 'U' THEN 5 WHEN 'S' THEN 10 ELSE 0 END, 'audit': b.audit || CASE state WHEN 'U' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END,
    'made': b.made || CASE state WHEN 'U' THEN ['assistant:'] WHEN 'S' THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END}} AS b FROM walk),
best AS (SELECT conv_id, arg_max(b, pos) AS b FROM (SELECT conv_id, pos, min(b) AS b FROM ended GROUP BY conv_id, pos) GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit,
  sha256(array_to_string(b.made, chr(10))) AS repaired_sha256
FROM best LEFT JOIN counts ON best.conv_id IS NOT DISTINCT FROM counts.conv_id
"""

ORACLE_SQL["op12_collocations"] = r"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
grams AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM pieces))) GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a FROM grams WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, a, j, array_to_string(string_split(c.phrase, ' ')[:j], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head AND x.k = j JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail AND y.k = c.k - j),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored) WHERE o = 1),
apart AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT lang, a, array_to_string(string_split(phrase, ' ')[2:], ' ') AS part FROM candidates WHERE k > 2 UNION ALL SELECT lang, a, array_to_string(string_split(phrase, ' ')[:k - 1], ' ') FROM candidates WHERE k > 2) e
    WHERE e.lang = b.lang AND e.part = b.phrase AND 100 * e.a >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM apart)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _secrets_sql() -> str:
    """Matches by the pieces between them; a weak span counts if what it wants starts within the reach of its start."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    good = {"assign": f"length(regexp_extract(s, {quoted(secrets.PATTERNS['assign'])}, 2)) >= 6", "key": "length(s) = 40 AND NOT regexp_matches(s, '[=_-]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[0-9]')"}
    kinds = " UNION ALL ".join(
        f"SELECT r, kind, o, a, a + length(s) AS b FROM (SELECT r, '{kind}' AS kind, {k} AS o, m[i] AS s, list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS a"
        f" FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, {quoted(pattern)}) AS m, regexp_split_to_array(t, {quoted(pattern)}) AS p FROM docs))) WHERE {good.get(kind, 'true')}"
        for k, (kind, pattern) in enumerate(secrets.PATTERNS.items())
    )
    near = lambda role: "EXISTS (SELECT 1 FROM spans y WHERE y.r = x.r AND y.kind IN (" + ", ".join(f"'{k}'" for k, v in secrets.ROLES.items() if v == role) + f") AND abs(y.a - x.a) <= {secrets.REACH})"
    wanted = " ".join(f"WHEN '{kind}' THEN {' AND '.join(map(near, roles))}" for kind, roles in secrets.WANTED.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({kinds}),
kept AS (SELECT r, kind, o, a, kind || ':' || a || ':' || b AS s FROM spans x WHERE CASE kind {wanted} ELSE true END),
lists AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(s, ',' ORDER BY a, o) FILTER (o < {len(secrets.BASE)}), '') AS base, string_agg(s, ',' ORDER BY a, o) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN lists USING (r)
"""


ORACLE_SQL["op13_linked_secrets"] = _secrets_sql()
