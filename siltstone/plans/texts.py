"""Text queries: lines, rules, secrets, clones, ids and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.strings import entropy, id_shape, last_name
from siltstone.operators import text
from siltstone.plans.bindings import table
from siltstone.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
LINES = "lin AS (SELECT doc_id AS id, i AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))"


@query(f"WITH {LINES} SELECT id, count(*) AS n, count(*) FILTER (length(text) > 400) AS long_lines, max(line) AS last FROM lin GROUP BY id")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 400).alias("long_lines"), F.max("line").alias("last"))


ENTROPY = "(SELECT round(coalesce(sum(k / n * log2(n / k)), 0), 6) FROM (SELECT count(*) AS k, length({0})::DOUBLE AS n FROM unnest(string_split({0}, '')) AS u(c) WHERE c <> '' GROUP BY c))"


@query("""WITH c AS (SELECT page_id, url, c, count(*)::DOUBLE AS k FROM pages, unnest(string_split(url, '')) AS u(c) WHERE c <> '' GROUP BY ALL)
SELECT page_id AS id, round(sum(k / length(url) * log2(length(url) / k)), 6) AS bits FROM c GROUP BY page_id""")
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.round(entropy(F.col("url")), 6).alias("bits"))


@query(r"""WITH n AS (SELECT doc_id AS id, md5(regexp_replace(regexp_replace(lower(text), '[\t\n\x0b\f\r ]+', ' ', 'g'), '^ | $', '', 'g')) AS hash FROM documents)
SELECT hash, count(*) AS n, min(id) AS first_id FROM n GROUP BY hash HAVING count(*) > 1""")
def exact_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.clone_groups(table(spark, sf_dir, "documents"), "doc_id", "text", min_lines=1).drop("gated")


CLONE_PAIRS = r"""d AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[\t\n\x0b\f\r ]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT id, list_transform(range(len(w) - 4), lambda i: substr(md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')), 1, 15)) AS g FROM w WHERE len(w) >= 5),
p AS (SELECT DISTINCT id, list_min(list_slice(g, i + 1, i + 4)) AS print FROM g, unnest(range(greatest(len(g) - 4, 0) + 1)) AS u(i)),
s AS (SELECT id, count(*) AS n FROM p GROUP BY id), j AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM p x JOIN p y ON x.print = y.print AND x.id < y.id GROUP BY ALL),
near AS (SELECT a, b, shared, round(100.0 * shared / least(m.n, k.n), 1) AS similarity FROM j JOIN s m ON m.id = a JOIN s k ON k.id = b WHERE round(100.0 * shared / least(m.n, k.n), 1) >= 60)"""


@query(f"WITH {CLONE_PAIRS} SELECT a, b, shared, similarity FROM near")
def near_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.near_clones(table(spark, sf_dir, "documents"), "doc_id", "text", percent=60)


@query(f"WITH {CLONE_PAIRS}, l AS (SELECT doc_id AS id, len(string_split(text, chr(10)))::INT AS lines FROM documents) SELECT a, b, similarity, least(x.lines, y.lines) AS lines, round(least(x.lines, y.lines) * similarity, 1) AS weight FROM near JOIN l x ON x.id = a JOIN l y ON y.id = b")
def near_clone_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near clones by size x similarity."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("lines"))
    return text.ranked_clones(text.near_clones(docs, "doc_id", "text", percent=60), sizes)


SHAPES = [
    ("override-phrase", "ignore", r"(?i)ignore (all )?(previous|prior) instructions"),
    ("fetch-and-run", "curl", r"curl [^|\n]*\| *(ba)?sh"),
    ("encoded-blob", "=", r"[A-Za-z0-9+/]{200,}={0,2}"),
    ("hidden-comment", "<!--", r"<!--[^>]*(ignore|secret|token|ad )[^>]*-->"),
]


@query(
    "WITH p AS (SELECT page_id AS id, html AS text FROM pages) "
    + " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM p WHERE contains(lower(text), '{k}') AND regexp_matches(text, '{r}')" for n, k, r in SHAPES).replace("SELECT id", "SELECT id", 1)
)
def instruction_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return text.rule_findings(pages, SHAPES).select("id", "rule")


@query("""WITH i AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'REQ-AUTH-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') WHEN 1 THEN 'TS-' || doc_id WHEN 2 THEN 'req-0001' WHEN 3 THEN 'ADR-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') ELSE 'XX-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') END AS ident FROM documents)
SELECT ident, regexp_matches(ident, '^(REQ|TS|ADR)(-[A-Z][A-Z0-9]*)*-[0-9]{4}$') AS ok, count(*) AS n FROM i GROUP BY ALL""")
def id_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    kind = F.col("doc_id") % 5
    ident = F.when(kind == 0, F.concat(F.lit("REQ-AUTH-"), number)).when(kind == 1, F.concat(F.lit("TS-"), F.col("doc_id").cast("string"))).when(kind == 2, "req-0001").when(kind == 3, F.concat(F.lit("ADR-"), number)).otherwise(F.concat(F.lit("XX-"), number))
    told = table(spark, sf_dir, "documents").select(ident.alias("ident"))
    return told.groupBy("ident").agg(F.count("*").alias("n")).select("ident", id_shape(F.col("ident"), ["REQ", "TS", "ADR"]).alias("ok"), "n")


KIT = ["blut", "mistyx", "powder", "lemo", "ghosts", "linen", "ivori", "oliv", "cream", "peech", "smal", "larg", "steele", "coper"]


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS name FROM part), k AS (SELECT unnest({KIT!r}) AS kit)
SELECT name, kit FROM w JOIN k ON levenshtein(name, kit) = 1""")
def near_miss_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kit's names are a parameter; every name is held against each by one array expression."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).distinct()
    near = F.filter(F.array(*map(F.lit, KIT)), lambda k: F.levenshtein(F.col("name"), k) == 1)
    return words.select("name", F.explode(near).alias("kit"))


@query("""SELECT page_id AS id, string_split(string_split(regexp_extract(url, '[^/]*$'), '::')[-1], '.')[-1] AS name FROM pages""")
def key_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), last_name(F.col("url")).alias("name"))


SHORT_BLOCK = 500
ANCHOR = 3


@query("SELECT d.doc_id AS id, b.item_id AS item FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def documented_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found verbatim, wherever they start.

    A passage's first and last words may be parts of longer ones, those between are whole words of any text that holds
    it: the hash of the first ``ANCHOR`` of these is the join key and the whole text decides. Passages with fewer words
    have no key and are tested as constants, ``SHORT_BLOCK`` in each pass over the texts.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    hashed = lambda w, at: F.xxhash64(*(F.get(w, at + k) for k in range(ANCHOR)))
    items = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("passage"), words("text").alias("w"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = items.where(F.size("w") >= ANCHOR + 2).select("item_id", "passage", hashed(F.col("w"), F.lit(1)).alias("key"))
    places = F.transform(F.sequence(F.lit(0), F.size("w") - ANCHOR), lambda i: hashed(F.col("w"), i))
    keys = docs.select("doc_id", words("text").alias("w")).where(F.size("w") >= ANCHOR).select("doc_id", F.explode(F.array_distinct(places)).alias("key"))
    hits = keys.join(keyed, "key").select("doc_id", "item_id", "passage")
    out = hits.join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select(F.col("doc_id").alias("id"), F.col("item_id").alias("item")).distinct()
    short = items.where(F.size("w") < ANCHOR + 2).select("item_id", "passage")
    block: list[tuple[int, str]] = []

    def tested() -> DataFrame:
        found = F.filter(F.array(*(F.struct(F.lit(i).alias("item"), F.lit(p).alias("p")) for i, p in block)), lambda x: F.contains("text", x["p"]))
        return docs.select(F.col("doc_id").alias("id"), F.explode(found).alias("f")).select("id", F.col("f.item").alias("item"))

    for row in short.toLocalIterator():
        block.append((row["item_id"], row["passage"]))
        if len(block) == SHORT_BLOCK:
            out = out.unionByName(tested())
            block = []
    return out.unionByName(tested()) if block else out
