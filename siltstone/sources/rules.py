"""Rule files and small structured documents, parsed on the driver or in Arrow batches."""

from __future__ import annotations

import hashlib
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.rules import Allow, SecretRule


def portable(pattern: str) -> str:
    """A rule's pattern in a form that Java reads: inline flags first, ``\\z`` spelled as Java spells it."""
    flags = "".join(dict.fromkeys("".join(re.findall(r"\(\?([a-z]+)\)", pattern))))
    body = re.sub(r"\(\?[a-z]+\)", "", pattern).replace(r"\Z", r"\z")
    return f"(?{flags}){body}" if flags else body


def toml_rules(spark: SparkSession, text: str) -> DataFrame:
    """Rules of a TOML file (``[[rules]]``): id, description, regex, path, entropy, keywords."""
    rows = [
        (r.get("id"), r.get("description"), portable(r["regex"]) if r.get("regex") else None, r.get("path"), float(r["entropy"]) if "entropy" in r else None, [k.lower() for k in r.get("keywords", [])])
        for r in tomllib.loads(text).get("rules", [])
    ]
    return spark.createDataFrame(rows, "id string, description string, regex string, path string, entropy double, keywords array<string>")


def secret_rules(text: str) -> tuple[list[SecretRule], list[tuple[str, str]], list[Allow]]:
    """The rules of a TOML rule file: line rules, rules on file names, and the allow lists of all rules.

    An allow list may name regular expressions, stopwords, paths, its ``regexTarget`` and an ``AND`` condition.
    Literals that look like credentials are kept as hashes only.
    """

    def allow(entry: dict) -> Allow:
        literal = lambda values: [v for v in values if looks_secret(v)]
        regexes, words = entry.get("regexes", []), entry.get("stopwords", [])
        hashed = [hashlib.sha256(v.encode()).hexdigest() for v in literal(regexes)] + [hashlib.sha256(w.lower().encode()).hexdigest() for w in literal(words)]
        return Allow(
            regexes=[portable(r) for r in regexes if not looks_secret(r)],
            stopwords=[w.lower() for w in words if not looks_secret(w)],
            hashes=hashed,
            paths=[portable(p) for p in entry.get("paths", [])],
            target={"line": "line", "match": "match"}.get(entry.get("regexTarget", ""), "secret"),
            every=entry.get("condition", "OR").upper() == "AND",
        )

    whole = tomllib.loads(text)
    lines, names = [], []
    for r in whole.get("rules", []):
        if "regex" not in r:
            names.append((r["id"], portable(r["path"])))
            continue
        lists = [allow(a) for a in r.get("allowlists", [])]
        path = portable(r["path"]) if "path" in r else None
        lines.append(SecretRule(r["id"], portable(r["regex"]), tuple(r.get("keywords", [])), r.get("entropy"), r.get("secretGroup", 1), path, tuple(lists)))
    common = [allow(a) for a in [whole.get("allowlist", {}), *whole.get("allowlists", [])] if a]
    return lines, names, common


def looks_secret(value: str) -> bool:
    """The driver's form of ``functions.code.credential_like``."""
    runs = [x for x in re.split(r"[^A-Za-z0-9_-]+", value) if len(x) >= 20]
    return not re.search(r"[\\^$.|?*+()\[\]{}]", value) and any(re.search("[A-Za-z]", x) and re.search("[0-9]", x) for x in runs)


class YamlError(ValueError):
    """A line that the YAML subset can't hold; the message names its number."""


def _scalar(text: str, line: int):
    text = text.strip()
    if text[:1] in "\"'":
        end = text.find(text[0], 1)
        if end < 0:
            raise YamlError(f"line {line}: unclosed quote")
        return text[1:end]
    text = re.match(r"(?:\"[^\"]*\"|'[^']*'|(?<!\s)#|[^#\"'])*", text)[0].strip()  # a comment starts after a blank
    if text.startswith("["):
        if not text.endswith("]"):
            raise YamlError(f"line {line}: unclosed list")
        return [_scalar(x, line) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", text[1:-1]) if x.strip()]
    return {"true": True, "false": False, "null": None, "": None}.get(text, int(text) if re.fullmatch(r"-?\d+", text) else text)


def parse_yaml(text: str):
    """Nested maps, lists, inline lists and quoted scalars; a repeated key or a broken line raises ``YamlError``."""
    rows = []
    for number, raw in enumerate(text.splitlines(), 1):
        if raw.strip() and not raw.lstrip().startswith("#") and raw.strip() != "---":
            if "\t" in raw[: len(raw) - len(raw.lstrip())]:
                raise YamlError(f"line {number}: tab in indentation")
            rows.append((number, len(raw) - len(raw.lstrip()), raw.strip()))

    def block(at: int, indent: int):
        return sequence(at, indent) if rows[at][2].startswith("- ") or rows[at][2] == "-" else mapping(at, indent)

    def sequence(at: int, indent: int):
        out = []
        while at < len(rows) and rows[at][1] == indent and (rows[at][2].startswith("- ") or rows[at][2] == "-"):
            number, _, body = rows[at]
            rest = body[1:].strip()
            if re.match(r"[\w.-]+:(\s|$)", rest):
                rows[at] = (number, indent + len(body) - len(rest), rest)
                value, at = mapping(at, rows[at][1])
            elif rest:
                value, at = _scalar(rest, number), at + 1
            else:
                value, at = block(at + 1, rows[at + 1][1]) if at + 1 < len(rows) and rows[at + 1][1] > indent else (None, at + 1)
            out.append(value)
        return out, at

    def mapping(at: int, indent: int):
        out = {}
        while at < len(rows) and rows[at][1] == indent:
            number, _, body = rows[at]
            found = re.match(r"(\"[^\"]+\"|'[^']+'|[^:#]+?)\s*:(?:\s+(.*))?$", body)
            if not found:
                raise YamlError(f"line {number}: not a key and value")
            key, rest = found[1].strip("\"'"), (found[2] or "").strip()
            if key in out:
                raise YamlError(f"line {number}: key {key} is there twice")
            if rest and not rest.startswith("#"):
                out[key], at = _scalar(rest, number), at + 1
            elif at + 1 < len(rows) and (rows[at + 1][1] > indent or rows[at + 1][1] == indent and rows[at + 1][2].startswith("- ")):
                out[key], at = block(at + 1, rows[at + 1][1])
            else:
                out[key], at = None, at + 1
        if at < len(rows) and rows[at][1] > indent:
            raise YamlError(f"line {rows[at][0]}: unexpected indentation")
        return out, at

    if not rows:
        return {}
    value, at = block(0, rows[0][1])
    if at < len(rows):
        raise YamlError(f"line {rows[at][0]}: unexpected indentation")
    return value


def yaml_leaves(files: DataFrame) -> DataFrame:
    """(path, key, value, error): every scalar of YAML files (path, text) under its dotted key; list items by number."""

    def walk(prefix: str, value) -> Iterator[tuple[str, str | None]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(f"{prefix}.{k}" if prefix else str(k), v)
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from walk(f"{prefix}[{k}]", v)
        else:
            yield prefix, None if value is None else str(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += [(path, k, v, None) for k, v in walk("", parse_yaml(text))]
                except YamlError as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "key", "value", "error"])

    return files.select("path", "text").mapInPandas(run, "path string, key string, value string, error string")


def front_matter(files: DataFrame) -> DataFrame:
    """(path, id, status, title, covers, body) of Markdown documents with front matter."""
    head = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ ]*\"?([^\"\n]*)\"?$", 1)), F.lit(""))
    covers = F.filter(F.split(F.regexp_extract(head, r"(?m)^covers:[ ]*\[([^\]]*)\]", 1), r"[,\s]+"), lambda x: x != "")
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n?", "")
    return files.select("path", field("id").alias("id"), field("status").alias("status"), field("title").alias("title"), covers.alias("covers"), body.alias("body"))


def markdown_tables(files: DataFrame) -> DataFrame:
    """(path, line, cells): rows of Markdown tables without their rules."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "row")).where(F.col("row").rlike(r"^\s*\|.*\|\s*$") & ~F.col("row").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace("row", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return lines.select("path", (F.col("pos") + 1).alias("line"), cells.alias("cells"))
