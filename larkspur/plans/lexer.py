"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from larkspur.errors import SyntaxProblem

#: Reserved words (fixed values of the dialect).
KEYWORDS = frozenset("select from where and insert into values delete update set create table int varchar view as index on".split())
_TOKEN = re.compile(
    r"""(?P<space>[\x00-\x20]+)
      | (?P<word>[A-Za-z_ -ÿ][A-Za-z0-9_ -ÿ]*)
      | (?P<int>-?[0-9]+)
      | '(?P<single>[^']*)'
      | "(?P<double>[^"]*)"
      | (?P<mark>.)""",
    re.VERBOSE | re.DOTALL,
)
INT_RANGE = range(-(1 << 31), 1 << 31)


@dataclass(frozen=True)
class Token:
    """kind is keyword, name, int, string, mark or end."""

    kind: str
    value: int | str
    position: int


def tokens(text: str) -> list[Token]:
    """All tokens, with an end token behind them. Words are lower-cased, strings are not."""
    found = []
    for m in _TOKEN.finditer(text):
        kind, at = m.lastgroup, m.start()
        if kind == "space":
            continue
        if kind == "word":
            word = m[0].lower()
            found.append(Token("keyword" if word in KEYWORDS else "name", word, at))
        elif kind == "int":
            value = int(m[0])
            if value not in INT_RANGE:
                raise SyntaxProblem(f"integer {m[0]} out of range", at)
            found.append(Token("int", value, at))
        elif kind in ("single", "double"):
            found.append(Token("string", m[kind], at))
        elif m[0] in "'\"":
            raise SyntaxProblem("string without an end", at)
        else:
            found.append(Token("mark", m[0], at))
    found.append(Token("end", "", len(text)))
    return found
