"""Boundary rules of the usage regex (Q23, Q24) and the escape helper."""

import re

from symdex.functions import regex as RX


def test_ascii_boundaries():
    p = re.compile(RX.whole_word("add"))
    assert p.search("x = add(1)")
    assert p.search("äadd")  # a non-ASCII letter is not a word character, so the boundary exists
    assert not p.search("_add")


def test_non_word_edges():
    p = re.compile(RX.whole_word("$x"))
    assert p.search("a$x") and not p.search(" $x ")  # \b before '$' needs a word character
    assert RX.escape("a.b*c") == r"a\.b\*c"


def test_definition_pattern_order():
    pats = RX.definition_patterns("f")
    assert len(pats) == 4 and "function" in pats[3]
