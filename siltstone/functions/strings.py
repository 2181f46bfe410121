"""Column functions over paths, ids, globs and characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_name(name: Column) -> Column:
    """Last path part, of that the last ``::`` part, of that the last ``.`` part."""
    for sign in ("/", "::", "."):
        name = F.element_at(F.split(name, re.escape(sign)), -1)
    return name


def folder(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob: ``**`` any folders, ``*`` within a name, a bare folder its subtree."""
    glob = glob.strip("/")
    if "*" not in glob and "." not in glob.rsplit("/", 1)[-1]:
        return f"^{re.escape(glob)}(/.*)?$" if glob else "^.*$"
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits, by array functions alone; 0 for an empty string.

    The characters are sorted once and cut into runs; a character is never counted twice.
    """
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))

    def bits(ordered: Column) -> Column:
        n = F.size(ordered).cast("double")
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1))), lambda i: ~F.get(ordered, i - 1).eqNullSafe(F.get(ordered, i - 2)))
        runs = lambda at: F.transform(at, lambda p, k: (F.coalesce(F.get(at, k + 1), F.size(ordered) + 1) - p).cast("double"))
        total = lambda sizes: F.aggregate(sizes, F.lit(0.0), lambda acc, k: acc + k / n * F.log2(n / k))
        return F.element_at(F.transform(F.array(starts), lambda at: total(runs(at))), 1)

    return F.when(text == "", 0.0).when(text.isNotNull(), F.element_at(F.transform(F.array(chars), bits), 1))


def id_shape(ident: Column, prefixes: list[str], digits: int = 4) -> Column:
    """Whether an id is ``PREFIX-`` and exactly ``digits`` digits, optionally with upper-case categories between."""
    return ident.rlike(f"^({'|'.join(map(re.escape, prefixes))})(-[A-Z][A-Z0-9]*)*-[0-9]{{{digits}}}$")


# The words that an id's domain part may be.
GLOSSARY = ["AUTH", "CORE", "DATA", "SEC"]


def id_problem(ident: Column, prefixes: list[str], domains: list[str] = tuple(GLOSSARY), digits: int = 4) -> Column:
    """Why an id is malformed, null for a good one: ``shape``, ``prefix``, ``digits`` or ``domain``.

    A good id is ``PREFIX-NNNN`` or ``PREFIX-DOMAIN-NNNN``, in upper case, with a domain of the glossary.
    """
    parts = F.split(ident, "-")
    shaped = ident.rlike(r"^[A-Z]+(-[A-Z][A-Z0-9]*)*-[0-9]+$")
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    strange = F.exists(middle, lambda m: ~m.isin(*domains))
    return F.when(~shaped, "shape").when(~parts[0].isin(*prefixes), "prefix").when(F.length(F.element_at(parts, -1)) != digits, "digits").when(strange, "domain")


def nearest(text: Column, words: list[str], most: int = 2) -> Column:
    """The word with the least edit distance to the text, null beyond ``most`` (ties: the first by name)."""
    near = F.transform(F.array(*map(F.lit, sorted(words))), lambda w: F.struct(F.levenshtein(text, w).alias("d"), w.alias("w")))
    best = F.array_min(near)
    return F.when(best["d"] <= most, best["w"])


def test_path(path: Column) -> Column:
    """The first test rule, one regular expression: a ``test`` or ``tests`` folder, or a file named like a test."""
    return path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.[a-z]+$|Tests?\.java$")


def test_folder_path(path: Column) -> Column:
    """The second test rule: a folder of a known name, a file named ``test_*``, or ``.test.`` or ``.spec.`` anywhere."""
    folders = F.array(*map(F.lit, ["tests", "test", "__tests__", "fixtures"]))
    name = F.element_at(F.split(path, "/"), -1)
    return F.arrays_overlap(F.split(path, "/"), folders) | F.startswith(name, F.lit("test_")) | F.contains(path, F.lit(".test.")) | F.contains(path, F.lit(".spec."))


def lease_minutes(lease: Column) -> Column:
    """Minutes of a lease such as ``4h``, ``30m`` or ``1h30m``; null for other texts."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(lease, f"([0-9]+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(lease.rlike("^([0-9]+d)?([0-9]+h)?([0-9]+m)?$") & (lease != ""), part("d") * 1440 + part("h") * 60 + part("m"))
