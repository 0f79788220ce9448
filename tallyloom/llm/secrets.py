"""Secrets in texts: patterns that say enough by themselves, and weak ones that count where their counterparts are near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Code points between the starts of parts of one credential, at most.
REACH = 200
# The base patterns, in the order in which they are listed, and after them the weak ones.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "key": r"[A-Za-z0-9+/=_-]{40,}",
    "login": r"""(?i)(user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""",
    "endpoint": r"""(?i)(https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""",
}
BASE = ("assign", "access", "hex")
#: What each kind is part of a credential as.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "key": "secret", "login": "identifier", "endpoint": "endpoint"}
#: What must lie in a weak candidate's scope.
WANTED = {"key": ("identifier",), "login": ("secret", "endpoint"), "endpoint": ("identifier", "secret")}


def _good(kind: str, match: Column) -> Column:
    """Whether a match counts: the value of an assignment is long enough, a key has 40 characters of three sorts."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 2)) >= 6
    if kind == "key":
        return (F.length(match) == 40) & ~match.rlike("[=_-]") & match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def _possible(kind: str, text: Column, low: Column) -> Column:
    """A cheap test that a text with a match passes."""
    some = lambda *words: F.lit(False) if not words else F.contains(low, F.lit(words[0])) | some(*words[1:])
    named = some("user", "login", "client", "account", "access")
    tests = {
        "assign": some("passw", "secret", "token", "api"),
        "access": F.contains(text, F.lit("AKIA")),
        "key": F.contains(text, F.lit("AKIA")) | named,
        "login": named,
        "endpoint": F.contains(text, F.lit("://")),
    }
    return tests.get(kind, F.lit(True))


def _found(kind: str) -> Column:
    """(gap before, size, good) of each match in order: the pieces between matches tell where these lie."""
    pattern, text = PATTERNS[kind], F.col("_text")
    sizes = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), _good(kind, match).alias("good")))
    none = F.array().cast("array<struct<gap: int, size: int, good: boolean>>")
    return F.when(_possible(kind, text, F.col("_low")), F.filter(sizes, lambda s: s["size"].isNotNull())).otherwise(none)


def _numbered(k: int, kind: str) -> Column:
    """A kind's matches with the kind's number and their own."""
    return F.transform(_found(kind), lambda s, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), s["gap"].alias("gap"), s["size"].alias("size"), s["good"].alias("good")))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, hits) of every row: texts are read once and stay where they are."""
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_low", F.lower("_text"))
    return cut(texts.select("_id", F.concat(*[_numbered(k, kind) for k, kind in enumerate(PATTERNS)]).alias("hits")).withColumn("_row", F.monotonically_increasing_id()))


def _spans(scanned: DataFrame) -> DataFrame:
    """(_row, kind, start, end) of the matches that count: a match starts after the pieces and matches before it."""
    hits = scanned.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(Window.partitionBy("_row", "kind").orderBy("i"))
    return hits.withColumn("end", end).where("good").select("_row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """The weak spans that lie, start from start, within `reach` of all they want.

    An interval join by bins of `reach` code points: of a role a bin keeps its first and last start, which
    tells for every place in it and beside it whether one is near enough. So a bin has one row, however
    many parts lie in it, and a candidate meets three."""
    kinds = list(PATTERNS)
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in kinds]), F.col("kind") + 1)
    parts = spans.withColumns({"bin": F.floor(F.col("start") / reach), "role": role})
    names = sorted(set(ROLES.values()))
    ends = [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_{n}") for r in names for n, f in (("first", F.min), ("last", F.max))]
    bins = parts.groupBy("_row", "bin").agg(*ends)
    weak = parts.where(F.col("kind") >= len(BASE)).select("_row", "kind", "start", "end", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = lambda r: F.coalesce(F.col(f"{r}_last").between(F.col("start") - reach, F.col("start") + reach) | F.col(f"{r}_first").between(F.col("start") - reach, F.col("start") + reach), F.lit(False))
    met = weak.join(bins, ["_row", "bin"]).groupBy("_row", "kind", "start", "end").agg(*[F.bool_or(near(r)).alias(r) for r in names])
    enough = F.lit(False)
    for k, kind in enumerate(kinds):
        if kind in WANTED:
            every = F.lit(True)
            for r in WANTED[kind]:
                every = every & F.col(r)
            enough = enough | ((F.col("kind") == k) & every)
    return met.where(enough).select("_row", "kind", "start", "end")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, kind, start, end) of what `scan_secrets` finds, one row for each span."""
    scanned = _scanned(docs, id_col, text_col)
    spans = cut(_spans(scanned))
    every = spans.where(F.col("kind") < len(BASE)).unionByName(_linked(spans, reach))
    name = F.element_at(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind") + 1)
    return every.join(scanned.select("_row", "_id"), "_row").select(F.col("_id").alias(id_col), name.alias("kind"), "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row of `docs`.

    Base spans are the matches, leftmost first and apart within a kind, of an assignment to a secret's
    name with a value of 6 characters, an access identifier of 20, and 24 hexadecimal digits. Weak
    candidates are 40 mixed characters (a key), an assignment to a user's name (a login) and an address
    (an endpoint). Within `reach` code points, start from start, a key counts beside an identifier (access
    or login), a login beside a secret (assignment, digits or key) and an endpoint, an endpoint beside an
    identifier and a secret. Spans are kind:start:end in code points, by start, then kind in that
    order, joined by commas; the digest is of the base ones alone.

    Null texts are empty; rows with one id, null or not, each keep their row; other columns are ignored; an
    empty table gives none. Only DataFrame functions are used: patterns run where the texts lie, and
    the places of matches, not texts, are shuffled."""
    scanned = _scanned(docs, id_col, text_col)
    spans = cut(_spans(scanned))
    every = spans.where(F.col("kind") < len(BASE)).unionByName(_linked(spans, reach))
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    lists = every.groupBy("_row").agg(ordered.alias("found"))
    name = F.array(*[F.lit(k) for k in PATTERNS])
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    told = lists.select("_row", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
    joined = scanned.select("_row", "_id").join(told, "_row", "left")
    none = {**{f"n_{kind}": F.lit(0).cast("long") for kind in BASE}, "base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return joined.select(F.col("_id").alias(id_col), *[F.coalesce(c, v).alias(c) for c, v in none.items()])
