"""Parsers of items that live in a folder of their own and are found at run time."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


class ParserUnavailable(RuntimeError):
    """No parser is named, or what is named can't be imported or lacks a function."""


@dataclass(frozen=True)
class Parser:
    """`encode` and `exclude` are `module:function` in `folder`. Workers import them from there, so the
    folder must be one that all of them see."""

    folder: str | None
    encode: str = "parser:encode"
    exclude: str | None = None

    def _found(self, name: str) -> Callable:
        if not self.folder:
            raise ParserUnavailable("no folder of a parser is named")
        root = Path(self.folder).expanduser().resolve()
        if not root.is_dir():
            raise ParserUnavailable(f"{root} is not there")
        if str(root) not in sys.path:
            sys.path.insert(0, str(root))
        module, _, function = name.partition(":")
        try:
            return getattr(importlib.import_module(module), function)
        except ImportError as missing:
            raise ParserUnavailable(f"{module} can't be imported from {root}: {missing}") from missing
        except AttributeError as missing:
            raise ParserUnavailable(f"{root}/{module} has no {function}") from missing

    def ensure(self) -> None:
        for name in (self.encode, self.exclude):
            if name:
                self._found(name)

    @property
    def available(self) -> bool:
        try:
            self.ensure()
        except ParserUnavailable:
            return False
        return True

    def describe(self) -> str:
        self.ensure()
        return f"{self.encode}@{Path(self.folder).expanduser().resolve()}"

    def __call__(self, value: str) -> tuple[str | None, str | None]:
        """(encoding, reason for exclusion) of a value."""
        reason = self._found(self.exclude)(value) if self.exclude else None
        return (None, str(reason)) if reason else (self._found(self.encode)(value), None)
