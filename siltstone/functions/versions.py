"""Version order that never fails, and the fix for a branch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = r"^v?([0-9]+(?:\.[0-9]+)*)"
PRERELEASE = r"(?i)^[-.]?(dev|a|alpha|b|beta|c|m|milestone|pre|preview|rc|cr|snapshot)"


def version_key(version: Column, prerelease_first: bool = False) -> Column:
    """Sort key: numbers of any length (digits without leading zeros after their count), then the rest.

    A text without a number sorts before all numbers. ``2.0-rc1`` sorts after ``2.0``, which is the order that the
    analyses are specified with; ``prerelease_first`` puts marked pre-releases before their release.
    """
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    numbers = F.filter(F.split(F.regexp_extract(version, NUMBERS, 1), r"\."), lambda x: x != "")
    head = F.array_join(F.transform(numbers, lambda x: F.concat(F.lpad(F.length(bare(x)).cast("string"), 4, "0"), F.lit(":"), bare(x))), ".")
    rest = F.regexp_replace(version, r"^v?[0-9]+(\.[0-9]+)*", "")
    mark = F.when(rest.rlike(PRERELEASE), " 0 ").otherwise(" 1 ") if prerelease_first else F.lit(" ")
    return F.concat(head, mark, rest)


def fixed_version(fixes: Column, current: Column) -> Column:
    """The least fix above the current version on its branch (first number), else the highest fix."""
    keyed = F.transform(fixes, lambda v: F.struct(version_key(v).alias("k"), v.alias("v")))
    branch = F.substring_index(current, ".", 1)
    ahead = F.filter(keyed, lambda x: (x["k"] > version_key(current)) & (F.substring_index(x["v"], ".", 1) == branch))
    return F.coalesce(F.array_min(ahead)["v"], F.array_max(keyed)["v"])
