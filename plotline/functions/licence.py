"""Whether a data source's declared licence lets its data be copied into a shared map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What licence texts say, tried in this order.
NAMED_COMPATIBLE = "rlis open database"
NON_COMMERCIAL = "by-nc|non-?commercial|not for commercial"
SHARE_ALIKE = "by-sa|share-?alike"
OPEN_DATABASE = r"\bodbl\b|opendatacommons\.org/licenses/odbl"
PUBLIC_DOMAIN = r"cc ?0|publicdomain/zero|public-domain/#cc0|pddl|public domain|^pd\b|\bpd \+|no restrictions|without attribution"
ATTRIBUTION = "cc by|licenses/by/"
INDEMNITY = "indemn"

STATUSES = ("COMPATIBLE", "PERMISSION", "NEEDS_WAIVER", "CHECK_TERMS", "NOT_COMPATIBLE", "UNKNOWN")


def licence_status(text: Column, url: Column, attribution: Column, share_alike: Column) -> Column:
    """Status of a declared licence; all four columns may be null."""
    said = F.trim(F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(url, F.lit("")))))
    credit = F.coalesce(attribution, F.lit(False))
    return (
        F.when(said.isin("", "unknown"), F.when(credit, "NEEDS_WAIVER").otherwise("UNKNOWN"))
        .when(said.rlike(NAMED_COMPATIBLE), "COMPATIBLE")
        .when(said.rlike(NON_COMMERCIAL), "NOT_COMPATIBLE")
        .when(said.rlike(SHARE_ALIKE) | (F.coalesce(share_alike, F.lit(False)) & ~said.rlike(OPEN_DATABASE)), "NOT_COMPATIBLE")
        .when(said.rlike(OPEN_DATABASE), "COMPATIBLE")
        .when(said.rlike(PUBLIC_DOMAIN) & ~said.rlike(INDEMNITY), "COMPATIBLE")
        .when(said.rlike(ATTRIBUTION), "NEEDS_WAIVER")
        .when(said.rlike(INDEMNITY), "CHECK_TERMS")
        .when(credit, "NEEDS_WAIVER")
        .otherwise("CHECK_TERMS")
    )


def licence_shown(text: Column, url: Column) -> Column:
    """The licence as shown: its text, cut to 120 characters, or else its address."""
    t = F.trim(F.coalesce(text, F.lit("")))
    cut = F.when(F.length(t) > 120, F.concat(F.substr(t, F.lit(1), F.lit(117)), F.lit("..."))).otherwise(t)
    return F.when(cut != "", cut).otherwise(url)


def assessed(permission: Column, state_law: Column, overrides: Column, declared: Column) -> Column:
    """Permission first, then a state law that overrides what is declared, then what is
    declared; a state law that doesn't override fills in where nothing is declared."""
    law = F.when(state_law.isNotNull() & F.coalesce(overrides, F.lit(False)), state_law)
    filled = F.when((F.coalesce(declared, F.lit("UNKNOWN")) == "UNKNOWN") & state_law.isNotNull(), state_law).otherwise(F.coalesce(declared, F.lit("UNKNOWN")))
    return F.coalesce(permission, law, filled)
