"""Repair of conversations: faults of their turns, and the cheapest edits that make their roles legal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, running

#: Turns of a conversation, and of its runs of turns, that one recursion walks through at most.
RUN = 64
#: Rows that one query of DuckDB gets, a run more or less.
BATCH = 20_000
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_BLANK, _OPEN = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: What a task knows of a run of turns: its ends, its counts, and its cheapest ways between states of the grammar.
_STATS = "first string, last string, first_turn long, last_turn long, low long, high long, turns long, illegal long, blank long, duplicate long, truncated long"
_STEPS = "array<struct<f: string, t: string, cost: bigint, audit: string>>"
_COUNTED = ("blank", "duplicate", "truncated")

# States: 0 nothing yet, S a system turn, U a user's, A an assistant's. Only before a user's turn after a user's, or
# an assistant's after none, a turn must be inserted; deletions come before insertions wherever both do.
_SINGLE = f"""
WITH states(f) AS (VALUES ('0'), ('S'), ('U'), ('A')),
letters(letter, f, t, pre) AS (VALUES ('s', '0', 'S', ''), ('u', '0', 'U', ''), ('u', 'S', 'U', ''), ('u', 'A', 'U', ''), ('u', 'U', 'U', 'I'),
  ('a', 'U', 'A', ''), ('a', '0', 'A', 'I'), ('a', 'S', 'A', 'I'), ('a', 'A', 'A', 'I')),
edits(edit, letter, cost) AS (VALUES ('K', 's', 0), ('K', 'u', 0), ('K', 'a', 0), ('R', 'u', {REROLE}), ('R', 'a', {REROLE}))
SELECT unit, pos, f, f AS t, {DELETE} * n AS cost, repeat('D', n) AS audit FROM placed, states
UNION ALL
SELECT unit, pos, f, t, {INSERT} * length(pre) + cost + {TRUNCATED} * truncated + {DELETE} * (n - 1), pre || edit || repeat('D', n - 1)
FROM placed JOIN edits ON edit = 'R' OR edits.letter = placed.first JOIN letters ON letters.letter = edits.letter WHERE NOT lost"""
_RUNS = "SELECT unit, pos, s.f, s.t, s.cost, s.audit FROM (SELECT unit, pos, unnest(steps) AS s FROM placed)"
_PLACED = """
SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ord) AS pos, lag(last) OVER (PARTITION BY unit ORDER BY ord) AS before, lag(last_turn) OVER (PARTITION BY unit ORDER BY ord) AS turn_before
FROM (SELECT *, dense_rank() OVER (ORDER BY conv, seg) AS unit FROM rows)"""
_WALK = """
WITH RECURSIVE sizes AS (SELECT unit, max(pos) AS pos, bool_or(head) AS head FROM placed GROUP BY unit),
best AS (SELECT unit, pos, f, t, min({'cost': cost, 'audit': audit}) AS b FROM steps GROUP BY unit, pos, f, t),
walk(unit, start, pos, state, b) AS (
  SELECT unit, f, 0::BIGINT, f, {'cost': 0::BIGINT, 'audit': ''} FROM sizes, (VALUES ('0'), ('S'), ('U'), ('A')) AS v(f) WHERE f = '0' OR NOT head
  UNION ALL
  SELECT unit, start, pos, t, min(b) FROM (
    SELECT w.unit, start, w.pos + 1 AS pos, s.t, {'cost': w.b.cost + s.b.cost, 'audit': w.b.audit || s.b.audit} AS b
    FROM walk w JOIN best s ON s.unit = w.unit AND s.pos = w.pos + 1 AND s.f = w.state) GROUP BY unit, start, pos, t),
ways AS (SELECT unit, list({'f': start, 't': state, 'cost': b.cost, 'audit': b.audit}) AS steps FROM walk JOIN sizes USING (unit, pos) GROUP BY unit),
stats AS (
  SELECT unit, any_value(seg) AS seg, min(ord) AS ord, bool_or(head) AS head, arg_min(first, ord) AS first, arg_max(last, ord) AS last, min(low) AS low, max(high) AS high,
    (sum(turns) - count(*) FILTER (first_turn = turn_before))::BIGINT AS turns, (sum(illegal) + count(*) FILTER (before || first NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal,
    sum(blank)::BIGINT AS blank, sum(duplicate)::BIGINT AS duplicate, sum(truncated)::BIGINT AS truncated
  FROM placed GROUP BY unit),
ends AS (SELECT unit, max(CASE WHEN pos = 1 THEN conv END) AS conv, max(CASE WHEN pos = 1 THEN first_turn END) AS first_turn FROM placed GROUP BY unit),
tails AS (SELECT unit, last_turn FROM placed JOIN sizes USING (unit, pos))
SELECT conv, seg, ord, stats.head, first, last, first_turn, last_turn, low, high, turns, illegal, blank, duplicate, truncated, steps
FROM stats JOIN ends USING (unit) JOIN tails USING (unit) JOIN ways USING (unit)"""


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) of what is left of the rows, by crc32(conv:turn) modulo 20: 0 drops a row,
    1 empties its text, 2 takes the ends of its sentences away, 3 repeats it, 4 makes it a user's. A
    null role or text is one space, as are a null conversation and turn in that key."""
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), F.col(turn_col).cast("string").alias("_turn"))
    key = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.coalesce("_turn", F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    left = own.withColumn("kind", kind).where("kind <> 0").withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return left.withColumn("_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _walks(single: bool):
    """Of each run (conv, seg) of rows the stats and the cheapest ways through it, by one recursion for all runs of a batch."""

    def walked(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB"}) as con:
            con.register("rows", pa.Table.from_batches(rows))
            con.execute(f"CREATE TEMP TABLE placed AS {_PLACED}")
            con.execute(f"CREATE TEMP TABLE steps AS {_SINGLE if single else _RUNS}")
            return con.sql(_WALK).to_arrow_table().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= BATCH:  # the last run may go on
                key = lambda k, b=batch: (b.column("conv")[k].as_py(), b.column("seg")[k].as_py())
                first = batch.num_rows - 1
                while first and key(first - 1) == key(batch.num_rows - 1):
                    first -= 1
                if first:
                    yield from walked([*held[:-1], batch.slice(0, first)])
                    held = [batch.slice(first)]
                    size = batch.num_rows - first
        if held:
            yield from walked(held)

    return run


def _counted(turns: DataFrame) -> DataFrame:
    """One row for equal rows (conv, turn, role, text): how many there are, their place among all rows, and their
    first fault. Copies but the first are duplicates."""
    text = F.col("text")
    light = turns.select("conv", "turn", "role", _digest().alias("digest"), (~text.rlike(_BLANK)).alias("is_blank"), (~text.rlike(_OPEN)).alias("is_open"))
    same = light.groupBy("conv", "turn", "role", "digest", "is_blank", "is_open").agg(F.count("*").alias("n"))
    placed = cut(running(same, ["conv", "turn", "role", "digest"], {}))
    firsts = placed.where("not is_blank").groupBy("conv", "role", "digest").agg(F.min("row").alias("row")).select("row", F.lit(1).alias("new"), F.lit(0).alias("head"))
    heads = placed.groupBy("conv").agg(F.min("row").alias("row")).select("row", F.lit(0).alias("new"), F.lit(1).alias("head"))
    marks = firsts.unionByName(heads).groupBy("row").agg(F.max("new").alias("new"), F.max("head").alias("head"))
    known = placed.join(marks, "row", "left").withColumns({"new": F.coalesce("new", F.lit(0)) == 1, "head": F.coalesce("head", F.lit(0)) == 1})
    once, first = F.col("n").cast("long"), F.substring("role", 1, 1)
    return known.select(
        "conv", F.floor(F.col("row") / RUN).cast("long").alias("seg"), F.col("row").alias("ord"), "head", first.alias("first"), first.alias("last"),
        F.col("turn").alias("first_turn"), F.col("turn").alias("last_turn"), F.col("turn").alias("low"), F.col("turn").alias("high"), F.col("turn").isNotNull().cast("long").alias("turns"), (once - 1).alias("illegal"),
        F.when(F.col("is_blank"), once).otherwise(0).alias("blank"), F.when(F.col("is_blank"), 0).otherwise(once - F.col("new").cast("long")).alias("duplicate"),
        (F.col("new") & F.col("is_open")).cast("long").alias("truncated"), once.alias("n"), (~F.col("new")).alias("lost"),
    )


def _whole(turns: DataFrame) -> DataFrame:
    """(conv, stats, steps) of each conversation: runs of RUN rows first, then runs of runs."""
    size, single, rows = partitions(turns.sparkSession), True, _counted(turns)
    conv = turns.schema["conv"].dataType.simpleString()
    while True:
        dealt = rows.repartition(size, "conv", "seg").sortWithinPartitions("conv", "seg")
        rows = cut(dealt.mapInArrow(_walks(single), f"conv {conv}, seg long, ord long, head boolean, {_STATS}, steps {_STEPS}"))
        if not rows.groupBy("conv").count().where("count > 1").limit(1).count():
            return rows
        rows, single = rows.withColumn("seg", F.floor(F.col("seg") / RUN)), False


def _cheapest() -> Column:
    """Of the ways from the start the cheapest one, with the turns that its end still wants."""
    more = lambda s: F.when(s["t"] == "U", "I").when(s["t"] == "S", "II").otherwise("")
    ends = F.transform(F.filter("steps", lambda s: s["f"] == "0"), lambda s: F.struct((s["cost"] + INSERT * F.length(more(s))).alias("cost"), F.concat(s["audit"], more(s)).alias("audit")))
    return F.array_min(ends)


def audited(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations of `turns` (conv,
    turn, role, text), and of `ids` (conv) if it names more.

    Turns are ordered by `turn` (nulls first), those of one turn by role, then by their text's SHA-256.
    Null roles and texts are one space; a null conversation is one of its own. Equal rows, adjacent in
    that order, are one with a number before anything is gathered. Rows get places by ranges, and runs of
    RUN places within a conversation are hash-partitioned: a long conversation is many runs. A recursive query
    of DuckDB in each batch of runs advances one turn for all of them, and keeps for each state of the
    grammar the least cost and, of equal ones, the least audit. Ways through runs are then
    joined to ways through conversations by the same recursion."""
    own = turns.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = _whole(own).withColumn("best", _cheapest())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = zero(F.col("high") - F.col("low") + 1 - F.col("turns"))
    counted = found.select(F.col("conv").alias("_conv"), gaps.alias("gaps"), *_COUNTED, "illegal", "best.cost", "best.audit")
    asked = (own if ids is None else ids).select("conv").distinct()
    joined = asked.join(counted, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv", *[zero(F.col(c)).alias(c) for c in ("gaps", *_COUNTED, "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"))


_DIGESTS = ("gaps", *_COUNTED, "illegal", "cost")


class _Repair:
    """The turns that an audit makes of those that come, one at a time."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, "0"

    def _next(self) -> str:
        self.state = "A" if self.state == "U" else "U"
        return "assistant" if self.state == "A" else "user"

    def inserted(self) -> Iterator[tuple[str, str, bytes]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), b""

    def turn(self, role: str, text: bytes) -> Iterator[tuple[str, str, bytes]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = role[0].upper()
            yield edit, role, text
        elif edit == "R":
            yield edit, self._next(), text


def _streamed(digests: bool):
    """Turns of a conversation behind its audit: their digest, or themselves. One turn is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        repair = whole = stats = None
        place = 0

        def take(made: Iterator[tuple[str, str, bytes]]) -> None:
            nonlocal place
            for edit, role, text in made:
                if digests:
                    whole.update((b"\n" if place else b"") + role.encode() + b":")
                    whole.update(text)
                else:
                    out.append([stats[0], place, edit, role, text.decode()])
                place += 1

        def ended() -> None:
            if repair is not None:
                take(repair.inserted())
                if digests:
                    out.append([*stats, whole.hexdigest()])

        schema = None
        for batch in batches:
            if schema is None:
                conv, long, string = batch.schema.field("conv").type, pa.int64(), pa.string()
                fields = [("conv", conv), *[(c, long) for c in _DIGESTS], ("audit", string), ("repaired_sha256", string)] if digests else [("conv", conv), ("place", long), ("edit", string), ("role", string), ("text", string)]
                schema = pa.schema(fields)
            tags, roles, texts = (batch.column(c).to_pylist() for c in ("tag", "role", "text"))
            for k, tag in enumerate(tags):
                if tag:
                    take(repair.turn(roles[k], texts[k]))
                else:
                    ended()
                    stats = [batch.column(c)[k].as_py() for c in ("conv", *_DIGESTS, "audit")]
                    repair, whole, place = _Repair(stats[-1]), hashlib.sha256(), 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _behind_audits(turns: DataFrame, ids: DataFrame | None, digests: bool) -> DataFrame:
    """Texts are shuffled once, behind the audit of their conversation, in the order in which it counts them."""
    conv = turns.schema["conv"].dataType.simpleString()
    texts = turns.select("conv", F.lit(1).alias("tag"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    texts = texts.withColumn("digest", _digest()).withColumn("text", F.col("text").cast("binary"))
    both = audited(turns, ids).withColumn("tag", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition(partitions(turns.sparkSession), "conv").sortWithinPartitions("conv", "tag", "turn", "role", "digest").drop("turn", "digest")
    counts = ", ".join(f"{c} long" for c in _DIGESTS)
    return dealt.mapInArrow(_streamed(digests), f"conv {conv}, {counts}, audit string, repaired_sha256 string" if digests else f"conv {conv}, place long, edit string, role string, text string")


def repaired_digests(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What `audited` returns, and the SHA-256 of the repaired turns, `role:text` joined by line ends. A digest
    is made of one byte after the other, so a conversation's turns pass one task, streaming from a
    sort that spills; nothing else of a long one does. No turns: zeros, no edits, the digest of nothing."""
    return _behind_audits(turns, ids, True)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text) of the repaired conversations: kept, reroled and inserted turns."""
    return _behind_audits(turns, None, False)
