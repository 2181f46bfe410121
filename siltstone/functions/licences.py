"""Licence classes and expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ["permissive", "weak", "strong", "proprietary", "unknown"]
# Licence id prefixes in lower case, each a whole word, and their class.
PREFIXES = {
    "permissive": ["mit", "apache", "bsd", "isc", "zlib", "unlicense", "0bsd", "cc0", "python", "psf", "wtfpl", "cc-by-4", "cc by 4"],
    "weak": ["lgpl", "mpl", "epl", "cddl", "cpl"],
    "strong": ["gpl", "agpl", "gnu general", "gnu affero", "cc-by-sa", "sspl", "osl", "eupl"],
    "proprietary": ["proprietary", "commercial", "all rights reserved", "cc-by-nc", "cc by-nc", "busl", "unlicensed"],
}


def licence_class(text: Column) -> Column:
    """Class of one licence text or id; null, blank and ``UNKNOWN`` are unknown.

    Classifier texts (``License :: OSI Approved :: ...``) are read by their last part.
    """
    low = F.lower(F.trim(F.element_at(F.split(F.coalesce(text, F.lit("")), "::"), -1)))
    low = F.regexp_replace(low, r"^(the )", "")
    out = F.lit("unknown")
    for name, prefixes in PREFIXES.items():
        out = F.when(low.rlike("^(" + "|".join(prefixes) + r")($|[^a-z])"), name).otherwise(out)
    return out


def expression_class(expression: Column) -> Column:
    """Class of a licence expression: ``OR`` takes the most permissive side, ``AND`` the most restrictive.

    ``AND`` binds closer; one level of parentheses is followed.
    """
    order = F.array(*map(F.lit, CLASSES))
    place = lambda x: F.array_position(order, licence_class(x)).cast("int")
    either = lambda x, part: F.array_min(F.transform(F.split(x, r"(?i)\s+or\s+(?![^(]*\))"), part))
    every = lambda x, part: F.array_max(F.transform(F.split(x, r"(?i)\s+and\s+(?![^(]*\))"), part))
    inner = lambda x: either(F.regexp_replace(x, r"^\s*\(|\)\s*$", ""), lambda o: every(o, place))
    return F.element_at(order, either(F.coalesce(expression, F.lit("")), lambda o: every(o, inner)))


def undecided(cls: Column, name: Column, allowed: list[str]) -> Column:
    """Strong, proprietary and unknown licences need a decision unless the name is on the allow list."""
    return cls.isin("strong", "proprietary", "unknown") & ~name.isin(*allowed)
