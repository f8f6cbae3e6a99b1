"""Small text rules over a user's SQL string (no parsing of the query).

The row cap is applied unless the statement already carries the word
``LIMIT``.  Unlike a plain substring test, string literals, quoted
identifiers and comments are ignored, and the word must stand alone, so a
column called ``credit_limit`` does not switch the cap off.
"""

from __future__ import annotations

import re

_LITERALS = re.compile(
    r"""'(?:[^']|'')*'"""          # 'single quoted'
    r"""|"(?:[^"]|"")*\""""        # "quoted identifier"
    r"""|`(?:[^`]|``)*`"""         # `backticked identifier`
    r"""|--[^\n]*"""               # -- line comment
    r"""|/\*.*?\*/""",             # /* block comment */
    re.S,
)
_LIMIT_WORD = re.compile(r"\bLIMIT\b", re.I)


def strip_trailing_semicolons(sql: str) -> str:
    return re.sub(r"[\s;]+$", "", sql)


def has_limit(sql: str) -> bool:
    """True when the word LIMIT appears outside literals and comments."""
    return bool(_LIMIT_WORD.search(_LITERALS.sub(" ", sql)))
