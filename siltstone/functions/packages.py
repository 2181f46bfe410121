"""Package URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ecosystem names and their package URL types.
TYPES = {"npm": "npm", "PyPI": "pypi", "RubyGems": "gem", "crates.io": "cargo", "Packagist": "composer", "Go": "golang", "Maven": "maven"}


def package_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """``pkg:type/name@version``; an npm scope is percent-encoded, Maven's group and artefact are path parts."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), ecosystem)
    path = F.when(ecosystem == "npm", F.regexp_replace(name, "^@", "%40")).when(ecosystem == "Maven", F.replace(name, F.lit(":"), F.lit("/"))).when(ecosystem == "PyPI", F.lower(name)).otherwise(name)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.lit("@"), version)
