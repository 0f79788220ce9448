"""An order-stable normal form of nested encodings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import COLOURS, SYMBOL, WIDER_SYMBOL

# Blocks whose children are sets, and fields that say what an item is and not what it does.
UNORDERED = frozenset(["CARD", "AND", "OR", "FILTER"])
HEADER = ("NAME", "MANA_COST", "TYPES", "SUPERTYPES", "SUBTYPES", "STATS", "POWER", "TOUGHNESS", "LOYALTY", "DEFENSE", "COLOR", "COLOR_IDENTITY")
# Fixed pattern: bindings.
BINDING = re.compile(r"\$[A-Za-z_][A-Za-z0-9_]*")
NUMBER = re.compile(r"\b\d+\b")
_QUOTED = re.compile('("[^"]*")')
#: Brackets and separators stand alone; a quote without another one is nothing.
_APART = str.maketrans({c: f" {c} " for c in "{}[],;"} | {'"': " "})


def lexemes(source: str) -> Iterator[str]:
    """Quoted strings as they are, brackets, separators, and what white space leaves between them."""
    for k, part in enumerate(_QUOTED.split(source)):
        if k % 2:
            yield part
        else:
            yield from part.translate(_APART).split()


class Block:
    """A head and its children: blocks, and statements as strings."""

    __slots__ = ("children", "head")

    def __init__(self, head: str):
        self.head, self.children = head, []

    @property
    def kind(self) -> str:
        return self.head.rstrip(":").strip().upper()


def parse(source: str) -> tuple[Block, bool]:
    """(the root block, whether a closing bracket without an opening one cut the rest off). Commas
    and semicolons end a statement, and a word that ends in a colon begins one."""
    root = Block("CARD")
    path, words = [root], []

    def end_statement() -> None:
        if words:
            path[-1].children.append(" ".join(words))
            words.clear()

    for lexeme in lexemes(source):
        match lexeme:
            case "{" | "[":
                inner = Block(" ".join(words))
                words.clear()
                path[-1].children.append(inner)
                path.append(inner)
            case "}" | "]":
                end_statement()
                path.pop()
                if not path:
                    return root, True
            case "," | ";":
                end_statement()
            case _:
                if lexeme.endswith(":"):
                    end_statement()
                words.append(lexeme)
    end_statement()
    return root, False


def _is_header(node: Block | str) -> bool:
    return node.kind in HEADER if isinstance(node, Block) else node.upper().startswith(tuple(f"{f}:" for f in HEADER))


def _shown(root: Block, header: bool, sort_all: bool) -> str:
    """The form of a block's children, from the innermost blocks outwards: a stack holds the blocks that
    are open, what is done of each and what is left, so depth costs memory and no recursion. Without
    `header`, fields that say what an item is are left out at the top and inside whole items."""
    parts: list[str] = []
    left, stack = iter(root.children), []
    block, whole = root, not header
    while True:
        node = next(left, None)
        if node is None:
            shown = ";".join(sorted(parts) if sort_all or block.kind in UNORDERED else parts)
            if not stack:
                return shown
            head = block.head
            block, parts, left, whole = stack.pop()
            parts.append(f"{head}{{{shown}}}")
        elif isinstance(node, Block) and not (whole and node.kind != "CARD" and _is_header(node)):
            stack.append((block, parts, left, whole))
            block, parts, left, whole = node, [], iter(node.children), whole and node.kind == "CARD"
        elif not isinstance(node, Block) and not (whole and _is_header(node)):
            parts.append(node)


#: The four forms: what they keep of the header, and whether sequences are sorted, too.
FORMS = {f"{scope}_{kind}": (scope == "full", kind == "strict") for scope in ("rules", "full") for kind in ("loose", "strict")}


def masked(encoding: str | None, name: str | None = None, mask_numbers: bool = False, mask_symbols: bool = False, wider_symbols: bool = False) -> str:
    """An encoding in one line, without comments, with bindings numbered, and masked as asked."""
    lines = [line for line in (encoding or "").splitlines() if line.strip() and not line.lstrip().startswith("#")]
    source = " ; ".join(lines)
    if name:
        source = source.replace(f'"{name}"', '"~"').replace(name, "~")
    order = {binding: f"${k}" for k, binding in enumerate(dict.fromkeys(BINDING.findall(source)))}
    source = BINDING.sub(lambda found: order[found[0]], source)
    if mask_numbers:
        source = NUMBER.sub("N", source)
    if mask_symbols:
        source = re.sub(COLOURS, "COLOR", re.sub(WIDER_SYMBOL if wider_symbols else SYMBOL, "{M}", source))
    return source


def canonical(encoding: str | None, scope: str = "rules", sort_all: bool = False, **masks) -> str:
    """Equal for encodings that differ in comments, layout, names of bindings, or the order of
    children that are sets. Scope `rules` leaves header fields out, `full` keeps them; `sort_all`
    sorts sequences too; the item's own name and, as asked, numbers and symbols are masked."""
    if scope not in ("rules", "full"):
        raise ValueError(f"scope is rules or full, not {scope!r}")
    return _shown(parse(masked(encoding, **masks))[0], scope == "full", sort_all)


def forms(encoding: str | None, **masks) -> dict[str, str]:
    """All four forms, by one parse."""
    root, _ = parse(masked(encoding, **masks))
    return {form: _shown(root, header, sort_all) for form, (header, sort_all) in FORMS.items()}


def forms_column(encoding: str, name: str, **masks) -> Column:
    """(text, rules_loose, rules_strict, full_loose, full_strict): the first form as it is, and digests of all
    four, which say whether forms are equal. An encoding is parsed once, in one Arrow call for all."""

    @pandas_udf("text string, " + ", ".join(f"{form} binary" for form in FORMS))
    def run(encodings: pd.Series, names: pd.Series) -> pd.DataFrame:
        found = [forms(e, name=n, **masks) for e, n in zip(encodings, names, strict=True)]
        digests = {form: [hashlib.sha256(f[form].encode()).digest() for f in found] for form in FORMS}
        return pd.DataFrame({"text": [f["rules_loose"] for f in found]} | digests)

    return run(F.col(encoding), F.col(name))


def canonical_column(encoding: str, name: str, **options) -> Column:
    """The normal form of a column, one Arrow batch at a time."""

    @pandas_udf("string")
    def run(encodings: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([canonical(e, name=n, **options) for e, n in zip(encodings, names, strict=True)])

    return run(F.col(encoding), F.col(name))


def truncated_column(encoding: str) -> Column:
    """Whether a stray closing bracket cut the encoding off."""

    @pandas_udf("boolean")
    def run(encodings: pd.Series) -> pd.Series:
        return pd.Series([parse(e or "")[1] for e in encodings])

    return run(F.col(encoding))
