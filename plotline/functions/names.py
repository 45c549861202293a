"""Street names compared without regard to case, accents and spelling, and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.functions.address import normalize_street, split_values, trimmed


def _per_name(change) -> Column:
    """An Arrow function of texts; ``change`` is local to its maker, so that it is sent along."""
    return F.pandas_udf(lambda names: names.map(change, na_action="ignore"), T.StringType())


def _composed(name: Column) -> Column:
    import unicodedata

    return _per_name(lambda n: unicodedata.normalize("NFC", n))(name)


def _without_marks(name: Column) -> Column:
    import unicodedata

    def bare(n: str) -> str:
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", n) if unicodedata.category(c)[0] != "M"))

    return _per_name(bare)(name)


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def canonical(name: Column) -> Column:
    """Composed, trimmed, single-spaced, in lower case."""
    composed = F.when(_ascii(name), name).otherwise(_composed(name))
    return F.lower(F.regexp_replace(trimmed(composed), r"\s+", " "))


def folded(canon: Column) -> Column:
    """Without combining marks."""
    return F.when(_ascii(canon), canon).otherwise(_without_marks(canon))


def expanded(fold: Column) -> Column:
    """Abbreviations in long form; null if a letter or digit is not ASCII, as these would be dropped."""
    long = normalize_street(fold)
    return F.when(~fold.rlike(r"[\p{L}\p{Nd}&&[^\x00-\x7F]]") & (long != ""), long)


def street_key(name: Column) -> Column:
    """What two spellings of one street share."""
    fold = folded(canonical(name))
    return F.coalesce(expanded(fold), fold)


def display_names(tags: Column, is_name: Column | None = None) -> Column:
    """All values of a road's name tags, parts between semicolons apart, each once."""
    from plotline.operators.settings import name_key

    own = F.map_values(F.map_filter(tags, lambda k, v: name_key(k)))
    return F.array_distinct(F.flatten(F.transform(own, split_values)))


def direction_text(dx: Column, dy: Column) -> Column:
    """"2.5 m west and 0.8 m south"; what is less than five centimetres is left out."""
    part = lambda d, more, less: F.when(F.abs(d) >= 0.05, F.format_string("%.1f m %s", F.abs(d), F.when(d > 0, more).otherwise(less)))
    both = F.concat_ws(" and ", part(dx, "east", "west"), part(dy, "north", "south"))
    return F.when(both != "", both)


def short_hash(text: Column) -> Column:
    """The first 16 digits of the MD5."""
    return F.substring(F.md5(text.cast("binary")), 1, 16)
