"""CVSS 3.x base scores and severity bands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric weights of the public CVSS 3.1 specification, section 7.4.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_CHANGED": {"N": 0.85, "L": 0.68, "H": 0.5},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
RANKS = ["none", "low", "unknown", "medium", "high", "critical"]
VALID = r"^CVSS:3\.[01]/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[HLN]/I:[HLN]/A:[HLN]$"


def _pick(vector: Column, metric: str, table: dict[str, float]) -> Column:
    value, out = F.regexp_extract(vector, rf"/{metric}:([A-Z])", 1), F.lit(None).cast("double")
    for letter, weight in table.items():
        out = F.when(value == letter, F.lit(weight)).otherwise(out)
    return out


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (as a lambda variable), which keeps generated code small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _round_up(x: Column) -> Column:
    """The specification's round-up to one decimal, in integers."""
    return _once(F.round(x * 100000).cast("long"), lambda whole: F.when(whole % 10000 == 0, whole / 100000.0).otherwise((F.floor(whole / 10000) + 1) / 10.0))


def base_score(vector: Column) -> Column:
    """Base score of a CVSS 3.0 or 3.1 vector; null for other versions and malformed vectors."""
    changed = vector.rlike("/S:C/")
    miss = (1 - _pick(vector, "C", WEIGHTS["C"])) * (1 - _pick(vector, "I", WEIGHTS["I"])) * (1 - _pick(vector, "A", WEIGHTS["A"]))
    impact = _once(1 - miss, lambda base: F.when(changed, 7.52 * (base - 0.029) - 3.25 * F.pow(base - 0.02, F.lit(15))).otherwise(6.42 * base))
    privileges = F.when(changed, _pick(vector, "PR", WEIGHTS["PR_CHANGED"])).otherwise(_pick(vector, "PR", WEIGHTS["PR"]))
    ease = 8.22 * _pick(vector, "AV", WEIGHTS["AV"]) * _pick(vector, "AC", WEIGHTS["AC"]) * privileges * _pick(vector, "UI", WEIGHTS["UI"])
    total = lambda part: F.least(F.when(changed, 1.08).otherwise(1.0) * (part + ease), F.lit(10.0))
    return F.when(vector.rlike(VALID), _once(impact, lambda part: F.when(part <= 0, F.lit(0.0)).otherwise(_round_up(total(part)))))


def label(score: Column) -> Column:
    """Severity of a score by the public bands; ``unknown`` for null."""
    return F.when(score.isNull(), "unknown").when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").otherwise("none")


def normal_label(text: Column) -> Column:
    """A database's own label in lower case, ``moderate`` as medium; anything else is unknown."""
    low = F.lower(F.trim(text))
    low = F.when(low == "moderate", "medium").otherwise(low)
    return F.when(low.isin(*RANKS), low).otherwise("unknown")


def rank(severity: Column) -> Column:
    """0 to 5; unknown stands above low and below medium."""
    return F.array_position(F.array(*map(F.lit, RANKS)), severity) - 1


def at_or_above(severity: Column, threshold: str) -> Column:
    return rank(severity) >= RANKS.index(threshold)
