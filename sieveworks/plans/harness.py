"""The relational operators bound to the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import names, predicates
from sieveworks.operators import grouping, matching, windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def missing_members(spark, d):
    return matching.without_partner(_t(spark, d, "orders"), _t(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_custkey")


@_query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def undeclared_documents(spark, d):
    return matching.without_partner(_t(spark, d, "documents"), _t(spark, d, "labels"), {"doc_id": "doc_id"}).select("doc_id", "lang")


@_query("SELECT doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id AND d.lang = 'fr')")
def declared_and_present(spark, d):
    return matching.with_partner(_t(spark, d, "labels"), _t(spark, d, "documents").where("lang = 'fr'"), {"doc_id": "doc_id"}).select("doc_id", "quality")


@_query("""
WITH r AS (SELECT p_partkey, p_name AS name, lower(split_part(p_name, ' ', 1)) AS canonical FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT p_brand AS scope, p_name AS name, lower(split_part(p_name, ' ', 1)) AS canonical FROM part WHERE p_partkey % 2 = 1),
g AS (SELECT scope, canonical, count(DISTINCT name) AS n, min(name) AS only_name FROM m GROUP BY ALL)
SELECT r.p_partkey, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.scope = p.p_brand AND m.name = r.name) THEN r.name WHEN g.n = 1 THEN g.only_name END AS member,
       coalesce(g.n, 0) AS candidates
FROM r JOIN part p ON p.p_partkey = r.p_partkey LEFT JOIN g ON g.scope = p.p_brand AND g.canonical = r.canonical
""")
def name_resolution(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("scope"), F.col("p_name").alias("name"), F.lower(F.substring_index("p_name", " ", 1)).alias("canonical"))
    found = matching.resolve(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["scope"], "name", "canonical")
    return found.select("p_partkey", "member", "candidates")


@_query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_identifiers(spark, d):
    return grouping.repeated(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("n") - 1).alias("repeats"))


@_query("SELECT doc_id, occurrence FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) AS INTEGER) AS occurrence FROM documents) WHERE occurrence > 1")
def repeated_occurrences(spark, d):
    return windows.repeats(_t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"]).select("doc_id", "occurrence")


@_query("SELECT sha256(text) AS content, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return grouping.repeated(_t(spark, d, "documents").select(F.sha2("text", 256).alias("content")), ["content"])


@_query("SELECT lower(p_name) AS key, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS names, CAST(count(DISTINCT p_brand) AS INTEGER) AS n FROM part GROUP BY lower(p_name) HAVING count(DISTINCT p_brand) > 1")
def part_name_collisions(spark, d):
    found = grouping.collisions(_t(spark, d, "part"), [], F.lower(names.extracts_to(F.col("p_name"))), "p_brand")
    return found.withColumn("names", F.array_join("names", ","))


@_query("SELECT p_name, count(DISTINCT p_brand) = 1 AS same_brand, count(DISTINCT p_size) = 1 AS same_size FROM part GROUP BY p_name")
def group_relations(spark, d):
    return grouping.same_within(_t(spark, d, "part"), ["p_name"], {"same_brand": F.col("p_brand"), "same_size": F.col("p_size")})


_PRIORITY = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END"


@_query(f"""
WITH c AS (SELECT o_orderkey, o_custkey AS id, o_orderstatus AS kind, {_PRIORITY} AS r FROM orders)
SELECT o_orderkey, id FROM c WHERE EXISTS (
  SELECT 1 FROM c o WHERE o.id = c.id AND o.kind <> c.kind AND (o.r = c.r OR o.r = '' OR c.r = ''))
""")
def kind_contradictions(spark, d):
    c = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.expr(_PRIORITY).alias("register"))
    c = c.withColumn("key", F.col("id").cast("string"))
    return matching.contradictions(c, [], "key", "kind", "register").select("o_orderkey", "id")


@_query("""
SELECT p_partkey, p_name, p_brand FROM part p
WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_brand = p.p_brand AND q.p_partkey <> p.p_partkey)
""")
def dangling_excluding_self(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return matching.only_self_declares(p, p, "p_partkey", ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand")


@_query("SELECT p_name, p_brand, count(DISTINCT p_partkey) AS owners FROM part GROUP BY ALL")
def identity_owners(spark, d):
    return grouping.owners_per_identity(_t(spark, d, "part"), ["p_name", "p_brand"], "p_partkey")


@_query("SELECT o_custkey, array_to_string(list_transform(list(o_orderkey ORDER BY o_orderdate, o_orderkey), lambda x: CAST(x AS VARCHAR)), ',') AS claims FROM orders GROUP BY o_custkey")
def claims_in_order(spark, d):
    g = grouping.in_order(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], [])
    return g.select("o_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("claims"))


@_query("SELECT p_partkey, p_brand FROM part WHERE p_brand IS NOT NULL AND p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23')")
def unknown_class(spark, d):
    known = spark.createDataFrame([(f"Brand#{i}{j}",) for i in (1, 2) for j in (1, 2, 3)], "word string")
    return matching.not_in_vocabulary(_t(spark, d, "part"), "p_brand", known, "word").select("p_partkey", "p_brand")


_ISO = ", ".join(f"'{c}'" for c in sorted(predicates.ISO_639_1))
_CODES = "SELECT doc_id AS id, lang AS code FROM documents UNION ALL SELECT o_orderkey, o_orderpriority FROM orders UNION ALL SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) FROM pages"


@_query(f"""
SELECT id, code, CASE WHEN regexp_extract(lower(code), '^[^-_]*') IN ({_ISO}) THEN regexp_extract(lower(code), '^[^-_]*') END AS stem FROM ({_CODES})
WHERE code IS NOT NULL AND lower(code) NOT IN ({_ISO}) AND NOT regexp_matches(lower(code), '^[a-z][a-z][a-z]$')
""")
def language_codes(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("code"))
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    pages = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1))
    codes = docs.union(orders).union(pages)
    return codes.where(F.col("code").isNotNull() & ~predicates.language_ok(F.col("code"))).withColumn("stem", predicates.language_stem(F.col("code")))


@_query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0")
def versions_without_primary(spark, d):
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("any")).where("NOT any").select("conv_id")


_CHARGE = "(length(html) - length(replace(html, '<', ''))) - (length(html) - length(replace(html, '</', ''))) // 2"


@_query(f"SELECT page_id, CAST({_CHARGE} AS INTEGER) AS charge FROM pages")
def markup_charge(spark, d):
    return _t(spark, d, "pages").select("page_id", predicates.markup_charge(F.col("html")).alias("charge"))


@_query(f"""
SELECT page_id, url, CAST({_CHARGE} AS INTEGER) AS charge,
       coalesce(sum({_CHARGE}) OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 200 AS spent FROM pages
""")
def element_budget(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url", predicates.markup_charge(F.col("html")).alias("charge"), F.split("url", "/")[2].alias("host"))
    return windows.spent_before(p, ["host"], ["page_id"], "charge", 200).select("page_id", "url", "charge", "spent")


_SEEN = "SELECT doc_id AS seq, lang AS rule, source AS container, n_chars AS size FROM documents"


def _listed(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("rule"), F.col("source").alias("container"), F.col("n_chars").alias("size"))
    return windows.listing(rows, "rule", "container", "seq", "size", cap=10, budget=400_000)


_LISTED = f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY rule, container ORDER BY seq) AS n FROM ({_SEEN})),
s AS (SELECT *, sum(CASE WHEN n <= 10 THEN size ELSE 0 END) OVER (PARTITION BY rule ORDER BY seq) AS spent FROM f),
stop AS (SELECT rule, min(seq) AS stop FROM s WHERE n <= 10 AND spent > 400000 GROUP BY rule),
full_of AS (SELECT rule, container, seq AS full_at FROM f WHERE n = 10),
l AS (SELECT s.seq, s.rule, s.container, CASE WHEN n <= 10 AND (stop IS NULL OR s.seq < stop) THEN 'listed'
        WHEN n > 10 AND (stop IS NULL OR full_at < stop) THEN 'suppressed' ELSE 'over_budget' END AS state
      FROM s LEFT JOIN stop ON s.rule = stop.rule LEFT JOIN full_of ON s.rule = full_of.rule AND s.container = full_of.container)
"""


@_query(f"{_LISTED} SELECT * FROM l")
def listing_cap(spark, d):
    return _listed(spark, d).select("seq", "rule", "container", "state")


@_query(f"{_LISTED} SELECT rule, container, count(*) AS suppressed FROM l WHERE state = 'suppressed' GROUP BY ALL")
def listing_cap_suppressed(spark, d):
    return _listed(spark, d).where("state = 'suppressed'").groupBy("rule", "container").agg(F.count(F.lit(1)).alias("suppressed"))


@_query(f"{_LISTED} SELECT rule, count(*) AS total, count(*) FILTER (state = 'listed') AS kept FROM l GROUP BY rule")
def listing_totals(spark, d):
    return _listed(spark, d).groupBy("rule").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "listed").alias("kept"))


@_query("SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) > 100000 AS refused FROM documents")
def archive_running_total(spark, d):
    return windows.budget_cut(_t(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 100_000).select("doc_id", "source", "refused")


@_query("""
SELECT o_orderkey, next_start FROM (SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS next_start FROM orders)
WHERE o_orderkey + o_custkey % 5 > next_start
""")
def overlapping_entries(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") + F.col("o_custkey") % 5).alias("end"))
    return windows.overlapping_neighbours(o, ["o_orderstatus"], "o_orderkey", "end").select("o_orderkey", "next_start")


@_query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_seen, sha256(text) AS content FROM documents")
def content_fingerprint(spark, d):
    return windows.first_seen(_t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content")), ["content"], "doc_id")


_FINDINGS = """
SELECT 'F1' AS rule, 'error' AS severity, 'container' AS about, o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL SELECT 'F2', 'warning', 'container', doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'M6', 'error', 'tool', conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0
"""


def _findings(spark, d):
    f = lambda df, rule, severity, about, c: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(about).alias("about"), F.col(c).alias("id"))
    a = f(missing_members(spark, d), "F1", "error", "container", "o_orderkey")
    b = f(undeclared_documents(spark, d), "F2", "warning", "container", "doc_id")
    return a.unionByName(b).unionByName(f(versions_without_primary(spark, d), "M6", "error", "tool", "conv_id"))


@_query(f"SELECT * FROM ({_FINDINGS})")
def findings(spark, d):
    return _findings(spark, d)


@_query(f"SELECT count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM ({_FINDINGS})")
def severity_summary(spark, d):
    return grouping.by_severity(_findings(spark, d))


@_query(f"SELECT severity, about, count(*) AS n FROM ({_FINDINGS}) GROUP BY ALL")
def about_summary(spark, d):
    return grouping.by_severity_and_subject(_findings(spark, d))


@_query(f"SELECT rule, count(*) AS n, min(id) AS first_id FROM ({_FINDINGS}) GROUP BY ALL")
def rule_histogram(spark, d):
    return _findings(spark, d).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@_query(f"""
SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, regexp_extract(rule, '^[A-Z]+'),
       CAST(regexp_extract(rule, '[0-9]+$') AS INTEGER), id) AS INTEGER) AS place, rule, id FROM ({_FINDINGS})
""")
def finding_order(spark, d):
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    order = [rank, F.regexp_extract("rule", "^[A-Z]+", 0), F.regexp_extract("rule", "[0-9]+$", 0).cast("int"), F.col("id")]
    return windows.numbered(_findings(spark, d), order, "place").select("place", "rule", "id")


@_query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority))[1:3], ',') AS first_values, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS in_all FROM orders GROUP BY o_custkey
""")
def first_few_kinds(spark, d):
    return grouping.first_few(_t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", 3).withColumn("first_values", F.array_join("first_values", ","))


_FORMATS = "(VALUES ('en', '.html'), ('de', '.htm'), ('fr', '.html')) AS t(lang, ext)"


@_query(f"""
WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(url, '^[^?#]*') AS path FROM pages)
SELECT page_id, t.lang, ext FROM p JOIN {_FORMATS} ON p.lang = t.lang WHERE NOT ends_with(lower(path), ext)
""")
def format_name_mismatch(spark, d):
    formats = spark.createDataFrame([("en", ".html"), ("de", ".htm"), ("fr", ".html")], "lang string, ext string")
    p = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.lower(F.regexp_extract("url", "^[^?#]*", 0)).alias("path"))
    return matching.described_by(p, formats, "lang", "inner").where(~F.endswith("path", F.col("ext"))).select("page_id", "lang", "ext")


_PATH = "regexp_replace(regexp_extract(url, '^[^?#]*'), '^https?://', '')"


@_query(f"""
WITH p AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS s FROM pages)
SELECT page_id, array_to_string(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/')), '|') AS prefixes FROM p
""")
def path_prefixes(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "^https?://", "")
    return _t(spark, d, "pages").select("page_id", F.array_join(grouping.path_prefixes(path), "|").alias("prefixes"))


@_query(f"""
WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS s FROM pages),
f AS (SELECT DISTINCT lang, array_to_string(s[1:i], '/') AS folder FROM (SELECT lang, s, unnest(range(1, len(s))) AS i FROM p))
SELECT lang, CAST(least(count(*), 256) AS BIGINT) AS n_folders, count(*) > 256 AS at_least FROM f GROUP BY lang
""")
def folder_totals(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "^https?://", "")
    p = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), path.alias("path"))
    return grouping.folders(p, ["lang"], "path", "page_id").select("lang", "n_folders", "at_least")


@_query(f"SELECT page_id FROM (SELECT page_id, {_PATH} AS p FROM pages) WHERE p LIKE 'm.ththnd.example.net/%' OR p LIKE '%/en/%'")
def inside_folders(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "^https?://", "")
    p = _t(spark, d, "pages").select("page_id", path.alias("path"))
    named = p.select(F.regexp_extract("path", "^(.*/en)/", 1).alias("folder")).where("folder <> ''").union(spark.createDataFrame([("m.ththnd.example.net",)], "folder string"))
    return matching.inside_any(p, "path", named, "folder").select("page_id")


@_query("""
SELECT r_name || '/' || n_name || '/' || c_name AS path, CAST(row_number() OVER (ORDER BY r_regionkey, n_nationkey, c_custkey) AS INTEGER) AS preorder, 2 AS depth
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
""")
def region_walk(spark, d):
    r, n, c = (_t(spark, d, t) for t in ("region", "nation", "customer"))
    tree = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    placed = windows.numbered(tree, [F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")], "preorder")
    return placed.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), "preorder", F.lit(2).alias("depth"))


@_query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def sealed_subtrees(spark, d):
    sealed = _t(spark, d, "nation").where("n_regionkey IN (1, 3)")
    return matching.without_partner(_t(spark, d, "customer"), sealed, {"c_nationkey": "n_nationkey"}).select("c_custkey")


@_query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 0 AND CAST(floor(l_extendedprice) AS BIGINT) // greatest(CAST(l_quantity AS BIGINT), 1) > 1500")
def suspicious_ratio(spark, d):
    size, packed = F.floor("l_extendedprice").cast("long"), F.col("l_quantity").cast("long")
    return _t(spark, d, "lineitem").where(predicates.suspicious_ratio(size, packed, floor=0, ratio=1500)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@_query("SELECT d.doc_id, l.quality = 1 AS declared FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def tri_state_declared(spark, d):
    return matching.declared_state(_t(spark, d, "documents"), _t(spark, d, "labels"), {"doc_id": "doc_id"}, F.col("quality") == 1).select("doc_id", "declared")


@_query("SELECT count(*) AS found, count(l.doc_id) AS read, count(*) = count(l.doc_id) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def read_completeness(spark, d):
    return grouping.completeness(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@_query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def present_names(spark, d):
    return _t(spark, d, "documents").select("doc_id").union(_t(spark, d, "labels").select("doc_id")).distinct()


@_query("(SELECT p_brand FROM part WHERE p_size < 10 EXCEPT SELECT p_brand FROM part WHERE p_size > 48) UNION ALL (SELECT p_brand FROM part WHERE p_size > 48 EXCEPT SELECT p_brand FROM part WHERE p_size < 10)")
def changed_names(spark, d):
    p = _t(spark, d, "part")
    a, b = p.where("p_size < 10").select("p_brand"), p.where("p_size > 48").select("p_brand")
    return a.exceptAll(b).distinct().join(b, "p_brand", "left_anti").union(b.distinct().join(a, "p_brand", "left_anti"))


_NAMES = (
    "a/b.pdf", "/etc/passwd", "C:\\x.pdf", "C:", "..", "a/../b", "a\\b", "a\\..\\b", "./B.pdf", "a//b/./c", "..a", "x/..b", "", "+007", "0", "7x", "12345678901234567890123", " 5 ", "true", "0 ", "application/PDF; x=1",
)
_NAME_ROWS = ", ".join("(" + "'" + n.replace("'", "''") + "')" for n in _NAMES)


@_query(f"""
SELECT name, CASE WHEN starts_with(name, '/') OR (length(name) > 2 AND regexp_matches(name, '^[A-Za-z]:[/\\\\]')) THEN 'absolute path'
    WHEN list_contains(string_split(replace(name, chr(92), '/'), '/'), '..') THEN 'parent directory segment' WHEN contains(name, chr(92)) THEN 'backslash separator' END AS unsafe,
  array_to_string(list_filter(string_split(name, '/'), lambda s: s <> '' AND s <> '.'), '/') AS lands_on,
  regexp_matches(name, '^[ \\t\\r\\n]*\\+?0*[1-9][0-9]*[ \\t\\r\\n]*$') AS positive,
  CASE WHEN trim(name) IN ('true', '1') THEN TRUE WHEN trim(name) IN ('false', '0') THEN FALSE END AS flag, lower(trim(split_part(name, ';', 1))) AS media
FROM (VALUES {_NAME_ROWS}) AS t(name)
""")
def name_predicates(spark, d):
    n = F.col("name")
    return spark.createDataFrame([(x,) for x in _NAMES], "name string").select(
        "name", predicates.unsafe_name(n).alias("unsafe"), names.extracts_to(n).alias("lands_on"), predicates.positive_integer(n).alias("positive"),
        predicates.xs_boolean(n).alias("flag"), predicates.media_type(n).alias("media"),
    )


@_query("""
WITH d AS (SELECT DISTINCT p_size, p_brand FROM part),
r AS (SELECT p_size, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY p_brand) - 1 AS spot, count(*) OVER (PARTITION BY p_size) AS n FROM d),
s AS (SELECT p_size, p_brand, spot, n, unnest(range(0, least(5, n - 1))) AS step FROM r),
p AS (SELECT s.p_size, s.p_brand, string_agg(o.p_brand, ',' ORDER BY step) AS partners
      FROM s JOIN r o ON s.p_size = o.p_size AND o.spot = (s.spot + 1 + step * greatest(1, s.n // 5)) % s.n GROUP BY ALL)
SELECT d.p_size, d.p_brand AS own, coalesce(partners, '') AS partners FROM d LEFT JOIN p ON d.p_size = p.p_size AND d.p_brand = p.p_brand
""")
def collision_partners(spark, d):
    own = _t(spark, d, "part").select("p_size", "p_brand").distinct()
    found = own.join(windows.partners(own, ["p_size"], "p_brand"), ["p_size", "p_brand"], "left")
    return found.select("p_size", F.col("p_brand").alias("own"), F.coalesce(F.array_join("partners", ","), F.lit("")).alias("partners"))


@_query("SELECT CASE WHEN ends_with(path, '.html') THEN 'html' WHEN regexp_matches(path, '\\.[a-z0-9]+$') THEN 'other' ELSE 'none' END AS kind, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[^?#]*')) AS path FROM pages) GROUP BY ALL")
def file_kinds(spark, d):
    path = F.lower(F.regexp_extract("url", "^[^?#]*", 0))
    kind = F.when(F.endswith(path, F.lit(".html")), "html").when(path.rlike(r"\.[a-z0-9]+$"), "other").otherwise("none")
    return _t(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
