"""Column expressions over delimited entity mentions.

A raw column holds mentions separated by ``;``. A mention is ``name,offset``,
or for locations ``type#..#name#..`` with the name in the third ``#`` field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MENTION_COLUMNS = {
    "persons": "V2Persons",
    "organizations": "V2Organizations",
    "locations": "V2Locations",
    "themes": "V2Themes",
}

# Fixed value: every Unicode decimal digit and the underscore.
DIGIT_OR_UNDERSCORE = r"[\p{Nd}_]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_mentions(c: Column | str) -> Column:
    """Mentions as an array; trailing empties stay, NULL gives an empty array."""
    return F.coalesce(F.split(_col(c), ";", -1), F.array().cast("array<string>"))


def mention_head(m: Column) -> Column:
    """Text before the first comma, unchanged."""
    return F.substring_index(m, ",", 1)


def entity_name(m: Column) -> Column:
    """Text before the first comma with blanks written as underscores."""
    return F.replace(mention_head(m), F.lit(" "), F.lit("_"))


def location_name(m: Column) -> Column:
    """Third ``#`` field, NULL when the mention has fewer fields."""
    return F.get(F.split(m, "#"), F.lit(2))


def mention_names(c: Column | str, kind: str = "other") -> Column:
    """Names of all mentions, malformed locations left out."""
    pick = location_name if kind == "locations" else entity_name
    return F.array_compact(F.transform(split_mentions(c), pick))


def distinct_names(c: Column | str, kind: str = "other", sep: str = ", ") -> Column:
    """Sorted, de-duplicated names joined by ``sep``; NULL input gives ''."""
    return F.array_join(F.sort_array(F.array_distinct(mention_names(c, kind))), sep)


def strip_digits(c: Column | str) -> Column:
    """Each digit and each underscore becomes one blank."""
    return F.regexp_replace(_col(c), DIGIT_OR_UNDERSCORE, " ")


def lower_themes(c: Column | str) -> Column:
    """Distinct theme names in lower case without digits."""
    return strip_digits(F.lower(distinct_names(c)))


def join_links(c: Column | str) -> Column:
    """List of links or names as comma text."""
    return F.array_join(_col(c), ",")


def split_links(c: Column | str) -> Column:
    """Comma text back to a list."""
    return F.split(_col(c), ",", -1)


def normalize_tickers(c: Column | str) -> Column:
    """Comma list of tickers, trimmed and upper-cased."""
    return F.transform(F.split(_col(c), ",", -1), lambda t: F.upper(F.trim(t)))


def normalize_sections(c: Column | str) -> Column:
    """Comma list of section names, trimmed, blanks dropped."""
    trimmed = F.transform(F.split(_col(c), ",", -1), lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: s != "")
