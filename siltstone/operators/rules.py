"""Rules over lines, units and files of source text.

A rule is a row of parameters. Line rules test a plain keyword before their regular expression; rules on units and
files are conditional aggregates, so all of them are one pass and one combined shuffle, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.strings import entropy


@dataclass(frozen=True)
class Allow:
    """What a secret rule leaves alone: regular expressions on the secret, the match or the line, lower-case stopwords
    within the secret, SHA-256 hashes of whole secrets, path expressions. ``every`` asks for all kinds at once."""

    regexes: Sequence[str] = ()
    stopwords: Sequence[str] = ()
    hashes: Sequence[str] = ()
    paths: Sequence[str] = ()
    target: str = "secret"
    every: bool = False

    def holds(self, path: Column, line: Column, match: Column, secret: Column) -> Column:
        on = {"secret": secret, "line": line, "match": match}[self.target]
        any_of = lambda tests: F.exists(F.array(*tests), lambda x: x) if tests else None
        kinds = [
            any_of([on.rlike(r) for r in self.regexes]),
            any_of([F.contains(F.lower(secret), F.lit(w)) for w in self.stopwords]),
            (F.sha2(secret, 256).isin(*self.hashes) | F.sha2(F.lower(secret), 256).isin(*self.hashes)) if self.hashes else None,
            any_of([path.rlike(r) for r in self.paths]),
        ]
        given = [k for k in kinds if k is not None]
        if not given:
            return F.lit(False)
        out = given[0]
        for k in given[1:]:
            out = out & k if self.every else out | k
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class SecretRule:
    """A provider's pattern: keywords gate the expression, ``group`` holds the secret, ``floor`` is its least entropy."""

    name: str
    regex: str
    keywords: Sequence[str] = ()
    floor: float | None = None
    group: int = 1
    path: str | None = None
    allow: Sequence[Allow] = field(default_factory=tuple)


def secret_findings(lines: DataFrame, rules: Sequence[SecretRule], allow: Sequence[Allow] = ()) -> DataFrame:
    """(path, line, rule, secret, bits) of lines (path, line, text): one finding a line, the first rule wins.

    A line without any keyword of a rule is never matched by it; the secret must reach the rule's entropy; allow lists
    of the rule and the common ones are tested on what is left. One pass, no shuffle.
    """
    path, text = F.col("path"), F.col("text")
    low = F.lower(text)
    hits = []
    for rule in rules:
        gate = F.lit(True)
        if rule.keywords:
            gate = F.exists(F.array(*(F.contains(low, F.lit(k.lower())) for k in rule.keywords)), lambda x: x)
        if rule.path:
            gate = gate & path.rlike(rule.path)
        match, secret = F.regexp_extract(text, rule.regex, 0), F.regexp_extract(text, rule.regex, rule.group)
        fit = (secret != "") & (F.lit(True) if rule.floor is None else entropy(secret) >= rule.floor)
        for a in [*rule.allow, *allow]:
            fit = fit & ~a.holds(path, text, match, secret)
        hits.append(F.when(gate & fit, F.struct(F.lit(rule.name).alias("rule"), secret.alias("secret"))))
    return lines.withColumn("hit", F.coalesce(*hits)).where("hit is not null").select("path", "line", "hit.rule", "hit.secret", F.round(entropy(F.col("hit.secret")), 6).alias("bits"))


def secret_files(files: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(path, rule): files that are secrets by their name, by rules (name, path expression)."""
    return files.select("path", F.coalesce(*(F.when(F.col("path").rlike(r), n) for n, r in rules)).alias("rule")).where("rule is not null")


def history_secrets(commits: DataFrame, rules: Sequence[SecretRule], allow: Sequence[Allow] = (), last: int | None = None) -> DataFrame:
    """(path, rule, secret, first_seen): secrets of file versions (seq, path, text), each file and secret once.

    ``last`` reads only that many of the newest commits (by ``seq``). Images, fonts, binaries and lock files are no input.
    """
    skip = r"(?i)\.(png|jpe?g|gif|ico|svg|woff2?|ttf|eot|pdf|zip|gz|jar|so|dll|exe|bin)$|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|go\.sum|composer\.lock)$"
    if last is not None:
        newest = commits.agg(F.max("seq").alias("__top"))
        commits = commits.join(F.broadcast(newest)).where(F.col("seq") > F.col("__top") - last).drop("__top")
    lines = commits.where(~F.col("path").rlike(skip)).select("seq", "path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    # ``line`` carries the commit, so that findings of all commits come from one pass
    found = secret_findings(lines.select("path", F.col("seq").alias("line"), "text"), rules, allow)
    return found.groupBy("path", "rule", "secret").agg(F.min("line").alias("first_seen"))


# Line rules of the general families as (rule, keyword, regular expression, weakness); Java and RE2 read
# the expressions alike. The keyword is a part of every line that the expression matches.
LINE_RULES = [
    ("shell with a command text", "shell", r"shell\s*=\s*True|shell:\s*true", "CWE-78"),
    ("system command", "system(", r"\bos\.system\(|\bRuntime\.getRuntime\(\)|(^|[^.\w])system\(", "CWE-78"),
    ("evaluated text", "eval(", r"(^|[^.\w])eval\(\s*[^)\"'\s]", "CWE-95"),
    ("statement put together", "select", r"(?i)[\"']\s*select\b[^\"']*[\"']\s*(\+|%|\.format\()", "CWE-89"),
    ("path from outside", "..", r"open\([^)]*\.\./", "CWE-22"),
    ("unsafe deserialisation", "load", r"\bpickle\.loads?\(|\byaml\.load\([^)]*\)|\bmarshal\.loads?\(", "CWE-502"),
    ("certificates not verified", "verify", r"verify\s*=\s*False|verify_mode\s*=\s*ssl\.CERT_NONE", "CWE-295"),
    ("connections without verification", "rejectunauthorized", r"rejectUnauthorized\s*:\s*false", "CWE-295"),
    ("debug mode", "debug", r"\bDEBUG\s*=\s*True\b|debug\s*=\s*True\b", "CWE-489"),
    ("weak hash", "md5", r"\b(hashlib\.)?md5\(|MessageDigest\.getInstance\(\"MD5\"\)", "CWE-327"),
    ("weak cipher mode", "ecb", r"(?i)/ECB/|MODE_ECB", "CWE-327"),
    ("weak randomness", "random", r"\bMath\.random\(\)|\brandom\.(random|randint|choice)\(.*(token|secret|key|password)", "CWE-338"),
    ("token not verified", "verify_signature", r"verify_signature[\"']?\s*:\s*False", "CWE-347"),
    ("cookie without flags", "cookie", r"(?i)(secure|httponly)\s*[:=]\s*false", "CWE-614"),
    ("markup from data", "innerhtml", r"\.innerHTML\s*=\s*[^\"'\s;]", "CWE-79"),
    ("forgery check off", "csrf", r"csrf_exempt|csrf\(\)\.disable\(\)|csrf\s*:\s*false", "CWE-352"),
    ("every origin allowed", "*", r"(?i)access-control-allow-origin[\"']?\s*[:,]\s*[\"']?\*|origins?\s*=\s*\[?[\"']\*", "CWE-942"),
    ("redirect from a parameter", "redirect", r"redirect\(\s*(request|req)\.", "CWE-601"),
    ("secret in a log", "log", r"(?i)\blog(ger)?\.\w+\(.*(password|secret|token)", "CWE-532"),
    ("plain address", "http://", r"(?i)[\"']http://[a-z0-9]", "CWE-319"),
    ("file open to all", "chmod", r"chmod\s+(-R\s+)?0?777|os\.chmod\([^)]*0o777", "CWE-732"),
    ("privileged container", "privileged", r"privileged:\s*true|--privileged\b", "CWE-250"),
    ("image without a version", "from", r"^FROM\s+[^:@\s]+(:latest)?\s*$", "CWE-1104"),
    ("fetched and run", "curl", r"curl\s[^|]*\|\s*(sudo\s+)?(ba|z)?sh\b", "CWE-829"),
    ("message to any origin", "postmessage", r"postMessage\([^)]*[\"']\*[\"']\)", "CWE-346"),
]


def weaknesses(lines: DataFrame, families: Sequence[tuple[str, str, str, str]] = tuple(LINE_RULES)) -> DataFrame:
    """(path, line, rule, cwe): one finding for each line (path, line, text) and rule; the keyword is tested first."""
    low = F.lower("text")
    hits = [F.when(F.contains(low, F.lit(key)) & F.col("text").rlike(pattern), F.struct(F.lit(rule).alias("rule"), F.lit(cwe).alias("cwe"))) for rule, key, pattern, cwe in families]
    return lines.select("path", "line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "line", "h.*")


@dataclass(frozen=True)
class ScopeRule:
    """A rule on a unit or file: one line matches ``when`` and none matches ``without``, in files of ``path``."""

    name: str
    when: str
    without: str | None = None
    path: str = ""
    cwe: str = ""


def scope_findings(lines: DataFrame, rules: Sequence[ScopeRule], *scope: str) -> DataFrame:
    """(scope..., line, rule, cwe): rules on presence and absence within a scope of lines (path, line, text, scope).

    The finding stands at the first line that matches. One conditional aggregate serves all rules; what leaves a task
    is one row a scope.
    """
    keys = list(scope) or ["path"]
    text, path = F.col("text"), F.col("path")
    cells = []
    for i, rule in enumerate(rules):
        inside = path.rlike(rule.path) if rule.path else F.lit(True)
        cells.append(F.min(F.when(inside & text.rlike(rule.when), F.col("line"))).alias(f"__w{i}"))
        if rule.without:
            cells.append(F.max(F.when(text.rlike(rule.without), F.lit(1))).alias(f"__n{i}"))
    table = lines.groupBy(*keys).agg(*cells)
    hit = lambda i, r: F.when(F.col(f"__w{i}").isNotNull() & (F.col(f"__n{i}").isNull() if r.without else F.lit(True)), F.struct(F.col(f"__w{i}").alias("line"), F.lit(r.name).alias("rule"), F.lit(r.cwe).alias("cwe")))
    return table.select(*keys, F.explode(F.array_compact(F.array(*(hit(i, r) for i, r in enumerate(rules))))).alias("h")).select(*keys, "h.*")


def conjunctions(lines: DataFrame, rules: Sequence[tuple[str, str, str]], *scope: str) -> DataFrame:
    """(scope..., rule): scopes in which one line matches the first expression of a rule (name, one, two) and one the second."""
    keys, text = list(scope) or ["path"], F.col("text")
    table = lines.groupBy(*keys).agg(*(F.bool_or(text.rlike(p)).alias(f"__{side}{i}") for i, (_, one, two) in enumerate(rules) for side, p in (("a", one), ("b", two))))
    names = F.array_compact(F.array(*(F.when(F.col(f"__a{i}") & F.col(f"__b{i}"), name) for i, (name, _, _) in enumerate(rules))))
    return table.select(*keys, F.explode(names).alias("rule"))


def absorb(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings (path, line, rule) without those inside a wider finding (path, start, end) that carries them."""
    lines = spans.select("path", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    return findings.join(lines, ["path", "line"], "left_anti")


def after_marker(lines: DataFrame, marker: str) -> DataFrame:
    """(path, line, text): lines with code below the first line that matches ``marker`` (code after the export)."""
    first = lines.where(F.col("text").rlike(marker)).groupBy("path").agg(F.min("line").alias("__at"))
    return lines.join(first, "path").where((F.col("line") > F.col("__at")) & (F.trim("text") != "")).select("path", "line", "text")


def repeated_marker(lines: DataFrame, marker: str) -> DataFrame:
    """(path, line): the second and later lines that match ``marker`` (a second export)."""
    order = Window.partitionBy("path").orderBy("line")
    return lines.where(F.col("text").rlike(marker)).withColumn("__n", F.row_number().over(order)).where("__n > 1").select("path", "line")


# First bytes of font files by suffix, in hexadecimal.
FONT_MAGIC = {"woff": "774F4646", "woff2": "774F4632", "ttf": "00010000", "otf": "4F54544F"}


def text_fonts(files: DataFrame) -> DataFrame:
    """(path): files (path, head) that are named like a font and don't start like one; ``head`` are the first bytes."""
    suffix = F.regexp_extract("path", r"\.([a-z0-9]+)$", 1)
    magic = F.try_element_at(F.create_map(*(F.lit(x) for kv in FONT_MAGIC.items() for x in kv)), suffix)
    return files.where(magic.isNotNull() & (F.substring(F.hex("head"), 1, 8) != magic)).select("path")


def neutralised(pattern: str) -> str:
    """A pattern that matches its own text, with an empty group in its longest literal run, so that it no longer does.

    The pattern's meaning stays. It keeps scanners from reading a rule file as the secrets it detects.
    """
    if not re.search(pattern, pattern, re.ASCII):
        return pattern
    longest = max(re.findall(r"[\w-]{8,}", pattern, re.ASCII), key=len, default="")
    return pattern.replace(longest, f"{longest[0]}(?:){longest[1:]}", 1) if longest else pattern


# Files that no rule reads, by kind: path expression and text expression (null: the path decides).
NOT_READ = [("terraform", r"\.(tf|tfvars)$", None), ("cloudformation", r"\.(ya?ml|json)$", "AWSTemplateFormatVersion"), ("helm", r"(^|/)Chart\.ya?ml$", None)]


def not_read(files: DataFrame) -> DataFrame:
    """(kind, n): files (path, text) of kinds that are not read, to be named in the report."""
    kind = F.coalesce(*(F.when(F.col("path").rlike(p) & (F.lit(True) if t is None else F.contains("text", F.lit(t))), k) for k, p, t in NOT_READ))
    return files.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def without_lockfile(manifests: DataFrame, locks: DataFrame, members: DataFrame) -> DataFrame:
    """(folder): folders of manifests (folder) that no lock file (folder) covers, by their own or a workspace root's.

    ``members(root, pattern)`` are the workspace globs of roots, relative to them, where ``*`` is one folder name. A
    folder meets roots by an equi-join on the folders above it, the pattern is tested on what is left.
    """
    open_ones = manifests.select("folder").distinct().join(locks.select("folder").distinct(), "folder", "left_anti")
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = open_ones.select("folder", F.explode(above).alias("root"))
    roots = members.join(locks.select(F.col("folder").alias("root")).distinct(), "root", "left_semi")
    below = F.when(F.col("root") == "", F.col("folder")).otherwise(F.substring(F.col("folder"), F.length("root") + 2, F.length("folder")))
    pattern = F.concat(F.lit("^"), F.replace(F.replace("pattern", F.lit("."), F.lit("\\.")), F.lit("*"), F.lit("[^/]+")), F.lit("$"))
    covered = up.join(roots, "root").where(F.regexp_like(below, pattern)).select("folder").distinct()
    return open_ones.join(covered, "folder", "left_anti")
