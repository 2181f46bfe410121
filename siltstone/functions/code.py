"""Column functions over source text: strings and comments, credentials, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings and comments of two families of languages, each one pattern that reads a text from left to right.
HASH_CODE = r"(?s)\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|[^\"'#]+|."
SLASH_CODE = r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[^\"'`/]+|."
HASH_LANGUAGES = ("python", "shell", "yaml", "ruby")


def code_only(text: Column, lang: Column) -> Column:
    """The text without strings and comments; line ends stay, so line numbers hold.

    One pattern cuts the text into strings, comments and the rest, from left to right, so a quote in a comment and a
    comment sign in a string mean nothing.
    """

    def cut(pattern: str, opening: str) -> Column:
        keep = lambda t: F.when(t.rlike(opening), F.regexp_replace(t, r"[^\n]", "")).otherwise(t)
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), keep), "")

    return F.when(lang.isin(*HASH_LANGUAGES), cut(HASH_CODE, r"(?s)^(#|[\"'].)")).otherwise(cut(SLASH_CODE, r"(?s)^(/\*|//|[\"'`].)"))


def credential_like(value: Column) -> Column:
    """A literal that a push scanner takes for a credential: no regex sign, and a run of 20 with letters and digits."""
    run = F.filter(F.split(value, "[^A-Za-z0-9_-]+"), lambda x: (F.length(x) >= 20) & x.rlike("[A-Za-z]") & x.rlike("[0-9]"))
    return ~value.rlike(r"[\\^$.|?*+()\[\]{}]") & (F.size(run) > 0)


def parameters(signature: Column) -> Column:
    """The parameters of a signature's first bracket, cut at commas outside of inner brackets, trimmed."""
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(state: Column, c: Column) -> Column:
        depth = state["depth"] + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)
        last = F.concat(F.slice(state["parts"], 1, F.size(state["parts"]) - 1), F.array(F.concat(F.element_at(state["parts"], -1), c)))
        fresh = (c == ",") & (state["depth"] == 0)
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), F.when(fresh, F.concat(state["parts"], F.array(F.lit("")))).otherwise(last).alias("parts"))

    arrows = F.replace(F.replace(inner, F.lit("=>"), F.lit("⇒")), F.lit("->"), F.lit("→"))  # no closing brackets
    found = F.aggregate(F.filter(F.split(arrows, ""), lambda c: c != ""), start, step)["parts"]
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")


def compatible(old: Column, new: Column, lang: Column) -> Column:
    """Whether callers of ``old`` may call ``new``: the old parameters stay, and what is added may be left out.

    An added parameter may be left out if it has a default (``=``, where ``=>`` is none), is marked optional (``?``,
    JavaScript) or gathers the rest (``*``, ``...``); in Rust and Java none may.
    """

    def judged(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        added = F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0)))
        default = lambda p: p.rlike(r"=") & ~lang.isin("rust", "java")
        free = lambda p: default(p) | (p.rlike(r"^[\w$]+\?") & (lang == "js")) | (p.rlike(r"^(\*|\.\.\.)") & ~lang.isin("rust", "java"))
        return (F.size(b) >= F.size(a)) & (F.slice(b, 1, F.size(a)) == a) & F.forall(added, free)

    return F.element_at(F.transform(F.array(F.struct(parameters(old).alias("a"), parameters(new).alias("b"))), judged), 1)
