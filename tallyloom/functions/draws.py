"""Seeded choices that any SQL engine repeats: order by md5 of seed and key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def ticket(seed: int, *keys: str | Column) -> Column:
    """A key's place in a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def draw(seed: int, *keys: str | Column) -> Column:
    """A key's number from 0 to 2^32 - 1."""
    return F.conv(F.substring(ticket(seed, *keys), 1, 8), 16, 10).cast("long")


#: Hexadecimal digits of a ticket that are counted at a time, and tickets that are looked at one by one.
DIGITS, FEW = 3, 1000


def border(tickets: DataFrame, n: int | Callable[[int], int]) -> tuple[str, int, int] | None:
    """(ticket, wanted, equal): the n-th of the `_ticket`s in order, how many of those equal to it are
    among the first n, and how many there are; None if there are no more than n. `n` may depend on their number.

    Tickets are spread evenly, so a histogram of their first digits says in which bin the n-th is, and one of
    that bin's next digits goes on: rounds grow with the logarithm of the rows, each gathers 4096 counts
    at most, and no rows are sorted or moved."""
    prefix, left, size = "", None, 0
    while left is None or (size > FEW and len(prefix) < 32):
        inside = tickets.where(F.startswith("_ticket", F.lit(prefix)))
        counts = inside.groupBy(F.substring("_ticket", len(prefix) + 1, DIGITS).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        if left is None:
            total = sum(r["n"] for r in counts)
            left = n(total) if callable(n) else n
            if total <= left:
                return None
        for r in counts:
            if left <= r["n"]:
                break
            left -= r["n"]
        prefix, size = prefix + r["p"], r["n"]
    if len(prefix) == 32:
        return prefix, left, size
    found = sorted(r["_ticket"] for r in tickets.where(F.startswith("_ticket", F.lit(prefix))).select("_ticket").collect())
    at = found[left - 1]
    return at, left - sum(t < at for t in found), found.count(at)


def sample(rows: DataFrame, n: int | None, keys: list[str], seed: int = SEED) -> DataFrame:
    """`n` rows without replacement, all if there are no more or n is 0 or None: those of the first tickets. Of
    rows with one key that of the last ticket takes, any do."""
    if not n:
        return rows
    keyed = rows.withColumn("_ticket", ticket(seed, *keys))
    last = border(keyed, n)
    if last is None:
        return rows
    at, wanted, equal = last
    if wanted == equal:
        return keyed.where(F.col("_ticket") <= at).drop("_ticket")
    return keyed.where(F.col("_ticket") < at).unionByName(keyed.where(F.col("_ticket") == at).limit(wanted)).drop("_ticket")


def quotient(above: Column, below: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))
