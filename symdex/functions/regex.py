"""Regex building blocks shared by the usage scan and the extractors.

Spark evaluates regexes with ``java.util.regex``.  Java's ``\\b`` is Unicode
aware, the behaviour reproduced here is the ASCII one, so word boundaries are
always spelled with explicit look-arounds over ``[A-Za-z0-9_]``.
"""

from __future__ import annotations

WORD = "A-Za-z0-9_"
# Whitespace as ECMAScript defines ``\s`` (ASCII set plus the Unicode spaces).
JS_SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

_SPECIAL = set(".*+?^${}()|[]\\")


def escape(text: str) -> str:
    """Backslash-escape regex metacharacters (same set in Java and RE2)."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def left_boundary(name: str) -> str:
    """Zero-width test equal to an ASCII ``\\b`` placed before ``name``."""
    return f"(?<![{WORD}])" if _is_word(name[0]) else f"(?<=[{WORD}])"


def right_boundary(name: str) -> str:
    """Zero-width test equal to an ASCII ``\\b`` placed after ``name``."""
    return f"(?![{WORD}])" if _is_word(name[-1]) else f"(?=[{WORD}])"


def whole_word(name: str) -> str:
    """Pattern of ``\\bNAME\\b`` with ASCII word boundaries."""
    return left_boundary(name) + escape(name) + right_boundary(name)


def definition_patterns(name: str) -> list[str]:
    """The four definition patterns, in priority order."""
    lb, esc = left_boundary(name), escape(name)
    return [
        f"{lb}{esc}{JS_SPACE}*\\(",
        f"{lb}{esc}{JS_SPACE}*\\{{",
        f"{lb}{esc}{JS_SPACE}*:",
        f"(?<![{WORD}])function{JS_SPACE}+{esc}{right_boundary(name)}",
    ]


def is_word_name(name: str) -> bool:
    """True when every character is an ASCII word character."""
    return bool(name) and all(_is_word(c) for c in name)


def sql_literal(text: str) -> str:
    """Single-quoted SQL string literal (no backslash escapes needed)."""
    return "'" + text.replace("'", "''") + "'"
