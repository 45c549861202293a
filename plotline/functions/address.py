"""Address text: normalised streets, house numbers and units, keys, comparison, expansion.

All functions take and return Columns and stay in the JVM. A blank value counts as a
missing one; missing streets and units normalise to the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Street words and their long forms.
EXPANSIONS = {
    "ave": "avenue", "av": "avenue", "blvd": "boulevard", "cir": "circle", "ct": "court",
    "dr": "drive", "expy": "expressway", "hwy": "highway", "ln": "lane", "pkwy": "parkway",
    "pl": "place", "rd": "road", "st": "street", "ter": "terrace", "terr": "terrace",
    "trl": "trail", "tr": "trail", "way": "way", "n": "north", "s": "south", "e": "east",
    "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "mt": "mount", "ft": "fort", "sq": "square", "hts": "heights", "jct": "junction",
    "lp": "loop", "pt": "point", "rte": "route", "xing": "crossing", "cv": "cove",
    "byp": "bypass", "aly": "alley", "plz": "plaza", "rdg": "ridge", "vw": "view",
}
DIRECTIONALS = ("n", "s", "e", "w", "ne", "nw", "se", "sw")
LEADING_WORDS = {"st": "Saint", "mt": "Mount", "ft": "Fort"}
UNIT_PREFIXES = ("unit ", "apt ", "apt. ", "suite ", "ste ", "ste. ", "#")

# Kinds of match with an address that is already there; the order is their strength.
KINDS = ("IDENTICAL", "PARTIAL", "UNIT_DIFF", "STREET_VARIANT", "STREET_DIFF", "OTHER_ADDRESS_ON_BUILDING")


def expansions() -> Column:
    return F.create_map(*[F.lit(x) for pair in EXPANSIONS.items() for x in pair])


#: All that counts as space at either end: the control characters and the space itself.
_CONTROLS = "".join(map(chr, range(33)))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_CONTROLS))


def blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def normalize_street(street: Column) -> Column:
    """Lower case, hyphens as spaces, nothing but a-z, 0-9 and spaces, words in long form."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.replace(street, F.lit("-"), F.lit(" "))), "[^a-z0-9 ]", ""), " +"), lambda w: w != "")
    long = F.transform(words, lambda w: F.coalesce(F.try_element_at(expansions(), w), w))
    return F.coalesce(F.array_join(long, " "), F.lit(""))


def normalize_housenumber(number: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(trimmed(number)), r"\s+", " "), F.lit(""))


def normalize_unit(unit: Column) -> Column:
    """Lower case without the unit words, each taken off once at most, in their order."""
    out = F.lower(trimmed(unit))
    for prefix in UNIT_PREFIXES:
        out = F.regexp_replace(out, unit_pattern(prefix), "")
    return F.coalesce(out, F.lit(""))


def unit_pattern(prefix: str) -> str:
    return "^" + prefix.strip().replace(".", "[.]") + (" +" if prefix.endswith(" ") else " *")


def with_normal(df: DataFrame, prefix: str = "") -> DataFrame:
    """The normalised parts as columns nn, ns and nu, so that pairs need not work them out again."""
    number, street, unit = (F.col(prefix + c) for c in ("number", "street", "unit"))
    return df.withColumns({f"{prefix}nn": normalize_housenumber(number), f"{prefix}ns": normalize_street(street), f"{prefix}nu": normalize_unit(unit)})


def address_key(number: Column, street: Column, unit: Column | None = None) -> Column:
    """The normalised address; without ``unit``, the key of its house number and street."""
    parts = [normalize_housenumber(number), normalize_street(street)]
    return F.concat_ws("|", *parts, *([] if unit is None else [normalize_unit(unit)]))


def exact_key(tags: Column) -> Column:
    """All ``addr:`` tags verbatim, sorted by key."""
    own = F.map_filter(tags, lambda k, v: F.startswith(k, F.lit("addr:")))
    entries = F.array_sort(F.map_entries(own))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\u0001")


def conflicting_keys(ours: Column, theirs: Column) -> Column:
    """``addr:`` keys that both have with values that differ but for case and outer spaces, sorted."""
    differ = F.map_filter(
        ours,
        lambda k, v: F.startswith(k, F.lit("addr:"))
        & F.map_contains_key(theirs, k)
        & (F.lower(F.trim(v)) != F.lower(F.trim(F.try_element_at(theirs, k)))),
    )
    return F.array_sort(F.map_keys(differ))


def fill_tags(ours: Column, theirs: Column) -> Column:
    """``addr:`` tags of ours whose keys theirs lacks."""
    return F.map_filter(ours, lambda k, v: F.startswith(k, F.lit("addr:")) & ~F.map_contains_key(theirs, k))


def compare(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How the address ``b``, already there, matches ``a``: one of KINDS, or null.

    Both are given as columns street, place, exact (see ``exact_key``) and the normalised
    nn, ns and nu (see ``with_normal``). Two missing streets, or units, are equal.
    """
    number_a, number_b, street_a, street_b = a["nn"], b["nn"], a["ns"], b["ns"]
    same_unit = a["nu"] == b["nu"]
    bare = blank(b["street"]) & blank(b["place"]) & ~(blank(a["street"]) & blank(a["place"]))
    same_street = (street_a == street_b) | (street_a == "") | (street_b == "")
    verbatim = F.lower(F.coalesce(F.trim(a["street"]), F.lit("null"))) == F.lower(F.coalesce(F.trim(b["street"]), F.lit("null")))
    return (
        F.when(a["exact"] == b["exact"], "IDENTICAL")
        .when((number_a == "") | (number_a != number_b), F.lit(None))
        .when(same_unit & bare, "PARTIAL")
        .when(same_street & same_unit, F.when(verbatim, "IDENTICAL").otherwise("STREET_VARIANT"))
        .when(same_street, "UNIT_DIFF")
        .when(same_unit, "STREET_DIFF")
    )


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1


def capitalize(word: Column) -> Column:
    """Upper case at the start and after a hyphen, apostrophe or full stop, and after a leading mc."""
    risen = F.aggregate(
        F.split(word, ""),
        F.struct(F.lit("").alias("out"), F.lit(True).alias("up")),
        lambda acc, c: F.struct(F.concat(acc["out"], F.when(acc["up"], F.upper(c)).otherwise(c)).alias("out"), c.isin("-", "'", ".").alias("up")),
        lambda acc: acc["out"],
    )
    mc = F.startswith(risen, F.lit("Mc")) & (F.length(risen) > 2)
    return F.when(mc, F.concat(F.lit("Mc"), F.upper(F.substr(risen, F.lit(3), F.lit(1))), F.substr(risen, F.lit(4)))).otherwise(risen)


def expand_street(street: Column) -> Column:
    """A street name in mixed case and long form: directions at either end, the type word
    in its place before a trailing direction, Saint, Mount and Fort in front."""
    words = F.split(F.trim(street), r"\s+")
    n = F.size(words)
    directions = F.array(*[F.lit(d) for d in DIRECTIONALS])
    leading = F.create_map(*[F.lit(x) for pair in LEADING_WORDS.items() for x in pair])
    last_is_direction = (n > 1) & F.array_contains(directions, F.lower(F.element_at(words, -1)))
    type_at = F.when(last_is_direction, n - 2).otherwise(n - 1)

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        long = F.try_element_at(expansions(), low)
        direction = F.array_contains(directions, low)
        return (
            F.when(((i == 0) | (i == n - 1)) & direction & (n > 1), capitalize(long))
            .when((i == 0) & F.map_contains_key(leading, low) & (n > 1), F.try_element_at(leading, low))
            .when((i == type_at) & (i > 0) & long.isNotNull() & ~direction, capitalize(long))
            .when(w.rlike(r"(?i)^\d+(st|nd|rd|th)$"), low)
            .otherwise(capitalize(low))
        )

    return F.when(F.coalesce(F.trim(street), F.lit("")) == "", street).otherwise(F.array_join(F.transform(words, word), " "))


def title_if_capitals(value: Column) -> Column:
    """Words capitalised if the value is all capitals, else the value as it is."""
    words = F.transform(F.split(F.lower(value), " "), capitalize)
    return F.when((value == F.upper(value)) & (F.lower(value) != F.upper(value)), F.array_join(words, " ")).otherwise(value)


def leading_number(value: Column) -> Column:
    """The number a house number starts with (up to nine digits), or -1."""
    return F.coalesce(F.regexp_extract(value, r"^\s*(\d{1,9})", 1).try_cast("bigint"), F.lit(-1))


def split_values(value: Column) -> Column:
    """Parts between semicolons, trimmed, spaces squeezed, without empty and repeated ones."""
    parts = F.transform(F.split(value, ";"), lambda p: F.regexp_replace(trimmed(p), r"\s+", " "))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def merge_sources(existing: Column, pending: Column) -> Column:
    """Two lists of sources as one, joined by ``; ``: parts differing only in case once, the first spelling kept."""
    parts = F.concat(split_values(F.coalesce(existing, F.lit(""))), split_values(F.coalesce(pending, F.lit(""))))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: F.lower(q) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "; ")
