"""SQL expressions for the address functions, for DuckDB."""

from __future__ import annotations

from plotline.functions.address import EXPANSIONS, KINDS, UNIT_PREFIXES, unit_pattern

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EXPANSIONS.items()) + "}"


def street(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower(replace({c}, '-', ' ')), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: w <> '')"
    return f"coalesce(array_to_string(list_transform({words}, lambda w: coalesce({_MAP}[w], w)), ' '), '')"


def number(c: str) -> str:
    return f"coalesce(regexp_replace(lower(trim({c})), '\\s+', ' ', 'g'), '')"


def unit(c: str) -> str:
    out = f"lower(trim({c}))"
    for p in UNIT_PREFIXES:
        out = f"regexp_replace({out}, '{unit_pattern(p)}', '')"
    return f"coalesce({out}, '')"


def normal(cte: str, new: str, p: str = "") -> str:
    """A CTE with the normalised parts of ``cte``'s address as columns {p}nn, {p}ns, {p}nu."""
    return f"{new} AS (SELECT *, {number(p + 'number')} AS {p}nn, {street(p + 'street')} AS {p}ns, {unit(p + 'unit')} AS {p}nu FROM {cte})"


def compare(a: str, b: str) -> str:
    """The kind of match between normalised addresses with column prefixes ``a`` and ``b``."""
    blank = lambda c: f"coalesce(trim({c}), '') = ''"
    bare = f"({blank(b + 'street')} AND {blank(b + 'place')} AND NOT ({blank(a + 'street')} AND {blank(a + 'place')}))"
    same_street = f"({a}ns = {b}ns OR {a}ns = '' OR {b}ns = '')"
    verbatim = f"lower(coalesce(trim({a}street), 'null')) = lower(coalesce(trim({b}street), 'null'))"
    return (
        f"CASE WHEN {a}exact = {b}exact THEN 'IDENTICAL' WHEN {a}nn = '' OR {a}nn <> {b}nn THEN NULL "
        f"WHEN {a}nu = {b}nu AND {bare} THEN 'PARTIAL' "
        f"WHEN {same_street} AND {a}nu = {b}nu THEN CASE WHEN {verbatim} THEN 'IDENTICAL' ELSE 'STREET_VARIANT' END "
        f"WHEN {same_street} THEN 'UNIT_DIFF' WHEN {a}nu = {b}nu THEN 'STREET_DIFF' END"
    )


KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
