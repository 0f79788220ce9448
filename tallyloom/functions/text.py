"""Scalar text expressions. White space and digits are ASCII, so that other SQL engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Primary types in order of precedence.
PRIMARY_TYPES = ("creature", "instant", "sorcery", "enchantment", "artifact", "planeswalker", "land")
# Marker lines, and names of their buckets.
GAP_MARKER, KEYWORD_MARKER = "# SPEC_GAP:", "# UNKNOWN_KEYWORD:"
SEPARATOR = " [SEP] "
# Fixed patterns: mana symbols, the same with those that end in P or N, and colour words.
SYMBOL = r"\{(?:[WUBRGCP0-9]+/)*[WUBRGC]\}"
WIDER_SYMBOL = r"\{(?:[WUBRGCP0-9N]+/)*[WUBRGCPN]\}"
COLOURS = r"(?i)\b(white|blue|black|red|green|colorless)\b"


def text(column: str | Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def stripped(column: str | Column) -> Column:
    return F.regexp_replace(text(column), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def squeezed(column: str | Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(column), r"[ \t\r\n]+", " "))


def number_template(column: str | Column) -> Column:
    """Digit runs become #, white space is squeezed, all lower case."""
    return F.lower(squeezed(F.regexp_replace(text(column), "[0-9]+", "#")))


def name_masked(body: str | Column, name: str | Column) -> Column:
    """Lower-case squeezed text with the row's own name replaced by ~; an empty name masks nothing."""
    low = F.lower(text(name))
    return F.when(low == "", F.lower(squeezed(body))).otherwise(F.replace(F.lower(squeezed(body)), low, F.lit("~")))


def primary_type(type_line: str | Column) -> Column:
    head = F.lower(F.split_part(text(type_line), F.lit("—"), F.lit(1)))
    found = F.lit("other")
    for kind in reversed(PRIMARY_TYPES):
        found = F.when(F.contains(head, F.lit(kind)), kind).otherwise(found)
    return found


def cost_band(cost: str | Column) -> Column:
    value = F.coalesce(F.col(cost) if isinstance(cost, str) else cost, F.lit(0)).cast("double")
    return F.when(value <= 1, "0-1").when(value <= 3, "2-3").when(value <= 5, "4-5").otherwise("6+")


def stratum(colours: str, cost: str, type_line: str) -> Column:
    """colours|cost band|primary type; no colours are C."""
    joined = F.when(F.size(F.coalesce(F.col(colours), F.array().cast("array<string>"))) > 0, F.array_join(F.array_sort(colours), "")).otherwise(F.lit("C"))
    return F.concat_ws("|", joined, cost_band(cost), primary_type(type_line))


def is_land(type_line: str | Column) -> Column:
    return F.contains(F.lower(text(type_line)), F.lit("land"))


def item_text(type_line: str, body: str) -> Column:
    """What an embedding model reads: the non-empty ones of type line and text."""
    return F.concat_ws(SEPARATOR, F.nullif(text(type_line), F.lit("")), F.nullif(text(body), F.lit("")))


def gap_category(line: str | Column) -> Column:
    """Of a marker line the category: unknown keywords are one bucket, and a line without a second
    colon has none."""
    line = F.col(line) if isinstance(line, str) else line
    rest = F.split_part(line, F.lit("SPEC_GAP:"), F.lit(2))
    return (
        F.when(F.contains(line, F.lit("UNKNOWN_KEYWORD")), "UNKNOWN_KEYWORD")
        .when(F.contains(line, F.lit("SPEC_GAP:")) & F.contains(rest, F.lit(":")), F.trim(F.split_part(rest, F.lit(":"), F.lit(1))))
        .otherwise("(uncategorized)")
    )


def marker_lines(encoding: str | Column, marker: str) -> Column:
    lines = F.transform(F.split(text(encoding), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: F.startswith(x, F.lit(marker)))


def without_comments(encoding: str | Column) -> Column:
    """Lines that are neither blank nor comments, joined by ` ; `."""
    kept = F.filter(F.split(text(encoding), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    return F.array_join(kept, " ; ")


def constructs(encoding: str | Column) -> Column:
    """The distinct construct keywords of an encoding."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(without_comments(encoding), F.lit(r"\b[A-Z][A-Z_]{2,}\b"), 0)))


def numbers_masked(column: str | Column) -> Column:
    return F.regexp_replace(text(column), r"\b[0-9]+\b", "N")


def symbols_masked(column: str | Column, wider: bool = False) -> Column:
    """Mana symbols become {M} and colour words COLOR. `wider` also takes symbols that end in P or N."""
    return F.regexp_replace(F.regexp_replace(text(column), WIDER_SYMBOL if wider else SYMBOL, "{M}"), COLOURS, "COLOR")


def percent(column: str | Column) -> Column:
    """One decimal, a dash for null."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.isNull(), F.lit("—")).otherwise(F.format_string("%.1f%%", value * 100))
