"""Column expressions used across operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symdex.schemas import OTHER_TYPE_PRIORITY, SYMBOL_TYPES, TYPE_PRIORITY


def type_priority(type_col: Column) -> Column:
    """Ranking priority of a symbol kind (F1)."""
    chain = None
    for kind, prio in TYPE_PRIORITY.items():
        cond = type_col == kind
        chain = F.when(cond, F.lit(prio)) if chain is None else chain.when(cond, F.lit(prio))
    return chain.otherwise(F.lit(OTHER_TYPE_PRIORITY))


def parse_symbol_type(text: str | None) -> str | None:
    """Case-insensitive kind name -> kind; unknown or empty -> None (no filter)."""
    if not text or not isinstance(text, str):
        return None
    low = text.lower()
    return low if low in SYMBOL_TYPES else None


def parse_symbol_type_col(text: Column) -> Column:
    """Column form of :func:`parse_symbol_type`."""
    low = F.lower(text)
    return F.when(low.isin(*SYMBOL_TYPES), low)


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot, '' when absent (H8)."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


# Characters ECMAScript's String.prototype.trim removes (whitespace and line terminators).
JS_WHITESPACE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(s: Column) -> Column:
    """Trim all leading/trailing whitespace (not only spaces) (H3)."""
    return F.btrim(s, F.lit(JS_WHITESPACE))


def is_private(symbol: Column, visibility: Column) -> Column:
    """Q21: private visibility, or a name starting with '_' or '#'."""
    return (F.coalesce(visibility, F.lit("")) == "private") | symbol.startswith("_") | symbol.startswith("#")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst may inline a projection into every place that references it;
    a lambda variable is evaluated once per row, so large shared
    intermediates (folded text, chunk records) are bound with this.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def kept(result, *cached):
    """Attach persisted intermediates to ``result`` so :func:`release` can drop them."""
    result._symdex_cached = list(getattr(result, "_symdex_cached", [])) + list(cached)
    return result


def release(*results) -> None:
    """Unpersist the intermediates an operator kept for its result(s)."""
    for r in results:
        for d in getattr(r, "_symdex_cached", []):
            d.unpersist()
        if hasattr(r, "_symdex_cached"):
            r._symdex_cached = []
