"""Queries of sources, memory, incremental, federation, review and export operators, and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import label_key
from tessera.operators import export, incremental, memory
from tessera.operators import graph as g
from tessera.operators import rules as r
from tessera.operators.search import neighbours, searchable
from tessera.plans.graph_queries import _category_sql, edges, nodes, scored  # noqa: F401
from tessera.plans.registry import GRAPH, SCORED, query
from tessera.session import read
from tessera.sources import extractors, text
from tessera.streaming import windows

EVENT = "SELECT user_id AS node, event_id, ts AS seen, CASE event_type WHEN 'view' THEN 'useful' WHEN 'click' THEN 'useful' WHEN 'error' THEN 'dead_end' ELSE 'corrected' END AS outcome FROM events"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "useful").when(F.col("event_type") == "error", "dead_end").otherwise("corrected")
    return read(spark, d, "events").select(F.col("user_id").alias("node"), "event_id", F.col("ts").alias("at"), kind.alias("outcome"))


NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query("g22_lessons", f"SELECT node, round(sum((CASE outcome WHEN 'useful' THEN 1 WHEN 'dead_end' THEN -1 ELSE 0 END) * pow(0.5, greatest(epoch_us({NOW}) - epoch_us(seen), 0) / 86400e6 / 30.0)), 6) AS score, count(*) FILTER (outcome = 'useful') AS pos, count(*) FILTER (outcome = 'dead_end') AS neg, CASE WHEN count(*) FILTER (outcome = 'useful') >= 2 AND count(*) FILTER (outcome = 'dead_end') = 0 THEN 'preferred' WHEN count(*) FILTER (outcome = 'useful') > 0 AND count(*) FILTER (outcome = 'dead_end') > 0 THEN 'contested' WHEN count(*) FILTER (outcome = 'useful') > 0 THEN 'tentative' ELSE 'avoided' END AS verdict FROM ({EVENT}) GROUP BY node")
def lessons(spark, d):
    return memory.lessons(_outcomes(spark, d), F.lit("2024-02-01 00:00:00").cast("timestamp")).drop("last")


@query("w02_provenance", f"SELECT node, place, event_id FROM (SELECT node, event_id, row_number() OVER (PARTITION BY node ORDER BY seen DESC, event_id DESC) AS place FROM ({EVENT})) WHERE place <= 5")
def provenance(spark, d):
    return memory.provenance(_outcomes(spark, d))


@query("y25_last_per_question", f"SELECT node, max(event_id) AS event_id FROM ({EVENT}) x WHERE (node, seen) IN (SELECT (node, max(seen)) FROM ({EVENT}) GROUP BY node) GROUP BY node")
def last_per_question(spark, d):
    return _outcomes(spark, d).groupBy("node").agg(F.max_by("event_id", F.struct("at", "event_id")).alias("event_id"))


@query("g23_plurality", "SELECT repo, lang FROM (SELECT repo, lang, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, lang) AS rk FROM sources WHERE lang IS NOT NULL GROUP BY repo, lang) WHERE rk = 1")
def plurality(spark, d):
    return memory.plurality(read(spark, d, "sources"), "repo", "lang")


@query("r01_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def sessions(spark, d):
    return memory.sessions(read(spark, d, "events"), "user_id", "ts", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("r01_stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = windows.run_once(windows.windowed(windows.stream(spark, f"{d}/events.parquet*")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, d, "sources").select(F.col("source_file").alias("path"), "mtime", F.md5(F.encode("content", "UTF-8")).alias("hash"))
    pick = lambda f, df: df.groupBy("path").agg(f(F.struct("mtime", "hash")).alias("x")).select("path", "x.*")
    return pick(F.min, s.where("mtime < timestamp_ntz'2025-09-01'")), pick(F.max, s.where("mtime > timestamp_ntz'2025-02-01'"))


@query("u07_changes", "WITH s AS (SELECT source_file AS path, mtime, md5(content) AS hash FROM sources), o AS (SELECT path, mtime, hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime, hash NULLS FIRST) AS rk FROM s WHERE mtime < TIMESTAMP '2025-09-01') WHERE rk = 1), w AS (SELECT path, mtime, hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, hash DESC NULLS LAST) AS rk FROM s WHERE mtime > TIMESTAMP '2025-02-01') WHERE rk = 1) SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN w.path IS NULL THEN 'deleted' WHEN o.mtime IS NOT DISTINCT FROM w.mtime OR coalesce(o.hash = w.hash, FALSE) THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN w ON o.path = w.path")
def changes(spark, d):
    return incremental.changes(*_manifests(spark, d))


@query("u10_cache_split", "SELECT DISTINCT md5(content) AS hash, md5(content) IN (SELECT md5(content) FROM sources WHERE content IS NOT NULL AND mtime < TIMESTAMP '2025-06-01') AS hit FROM sources WHERE content IS NOT NULL")
def cache_split(spark, d):
    s = read(spark, d, "sources").where("content is not null").select("mtime", F.md5(F.encode("content", "UTF-8")).alias("hash"))
    return incremental.cache_split(s, s.where("mtime < timestamp_ntz'2025-06-01'"), "hash")


@query("j08_replace_by_owner", "WITH f AS (SELECT seq, id, source_file FROM nodes WHERE captured_at >= TIMESTAMP '2025-08-01'), o AS (SELECT seq, id, source_file FROM nodes WHERE captured_at < TIMESTAMP '2025-08-01'), g AS (SELECT source_file FROM f WHERE source_file IS NOT NULL UNION SELECT source_file FROM nodes WHERE repo = 'ember_crane' AND source_file IS NOT NULL) SELECT * FROM o WHERE source_file IS NULL OR source_file NOT IN (SELECT source_file FROM g) UNION ALL SELECT * FROM f")
def replace_by_owner(spark, d):
    n = read(spark, d, "nodes")
    fresh = n.where("captured_at >= timestamp_ntz'2025-08-01'").select("seq", "id", "source_file")
    return incremental.replace_by_owner(n.where("captured_at < timestamp_ntz'2025-08-01'"), fresh, "source_file", n.where("repo = 'ember_crane'"))


@query("f20_unexplained_losses", "SELECT id FROM (SELECT DISTINCT id, source_file FROM nodes WHERE captured_at < TIMESTAMP '2025-06-01') WHERE id NOT IN (SELECT id FROM nodes WHERE captured_at >= TIMESTAMP '2025-03-01' AND id IS NOT NULL) AND source_file <> '' AND source_file NOT IN (SELECT source_file FROM nodes WHERE captured_at >= TIMESTAMP '2025-03-01' AND source_file IS NOT NULL)")
def losses(spark, d):
    n = read(spark, d, "nodes")
    new = n.where("captured_at >= timestamp_ntz'2025-03-01'")
    return incremental.unexplained_losses(n.where("captured_at < timestamp_ntz'2025-06-01'").select("id", "source_file").distinct(), new, new)


@query("j28_merge_by_label", GRAPH + "SELECT n.id, CASE WHEN coalesce(source_file,'') = '' AND home IS NOT NULL THEN home ELSE n.id END AS merged FROM n LEFT JOIN (SELECT label, min(id) AS home FROM n WHERE coalesce(source_file,'') <> '' AND label IS NOT NULL GROUP BY label) k ON k.label = n.label")
def merge_by_label(spark, d):
    return incremental.merge_by_label(nodes(spark, d))


@query("j14_unique_targets", GRAPH + "SELECT name, min(id) AS id FROM (SELECT regexp_replace(lower(label), '\\(\\)$', '') AS name, id FROM n WHERE label IS NOT NULL) GROUP BY name HAVING count(*) = 1")
def unique_targets(spark, d):
    n = nodes(spark, d).where("label is not null")
    return incremental.unique_label_targets(n, n.select(r.bare_name(F.col("label")).alias("name")))


@query("j07_group_members", "SELECT o_orderkey AS \"group\", count(DISTINCT l_partkey) AS members FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def group_members(spark, d):
    groups = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group")).agg(F.collect_set("l_partkey").alias("members"))
    known = read(spark, d, "orders").select(F.col("o_orderkey").alias("group"))
    return incremental.members(groups.join(known, "group", "left_semi"), read(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id")))


@query("g07_label_groups")
def label_groups(spark, d):
    x = read(spark, d, "nodes").where("label is not null and source_file <> '' and id is not null and file_type <> 'code'").select("id", "label", "source_file").distinct()
    x = x.withColumn("k", label_key(F.col("label"))).where("k <> ''")
    return x.groupBy("k", "source_file").agg(F.min_by("id", F.struct(F.length("id"), "id")).alias("winner"), F.countDistinct("id").alias("ids")).where("ids > 1")


@query("y07_label_index", "SELECT regexp_replace(lower(label), '\\(\\)$', '') AS name, count(DISTINCT id) AS ids FROM nodes WHERE label IS NOT NULL AND id IS NOT NULL GROUP BY 1")
def label_index(spark, d):
    return read(spark, d, "nodes").where("id is not null and label is not null").groupBy(r.bare_name(F.col("label")).alias("name")).agg(F.countDistinct("id").alias("ids"))


@query("y08_existing_triples", "SELECT DISTINCT source, target, relation FROM edges WHERE source <> '' AND target <> ''")
def triples(spark, d):
    return read(spark, d, "edges").where("source <> '' and target <> ''").select("source", "target", "relation").distinct()


@query("p21_suffix_matches", "SELECT DISTINCT d.doc_id, s.source_file FROM documents d JOIN (SELECT DISTINCT source_file, regexp_replace(source_file, '^[^/]+/', '') AS tail FROM sources) s ON d.source_file = s.source_file OR d.source_file = s.tail")
def suffix_matches(spark, d):
    # a suffix bounded by slashes is an equality with one of the other path's tails, so this stays an equi-join
    s = read(spark, d, "sources").select("source_file").distinct()
    docs = read(spark, d, "documents").select("doc_id", F.col("source_file").alias("path"))
    parts = lambda c: F.split(c, "/")
    tails = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/")))
    shorter = docs.join(s.select("source_file", tails("source_file").alias("path")), "path").select("doc_id", "source_file")
    longer = docs.where("path is not null").select("doc_id", tails("path").alias("source_file")).join(s, "source_file").select("doc_id", "source_file")
    return shorter.unionByName(longer).distinct()


PR = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'dev' ELSE 'main' END AS base, CASE doc_id % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'SUCCESS' ELSE CASE WHEN doc_id % 3 = 0 THEN 'FAILURE' ELSE 'NONE' END END AS ci, CASE doc_id % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'CHANGES_REQUESTED' END AS review, doc_id % 13 = 0 AS draft, datediff('day', captured_at, TIMESTAMP '2026-01-01')::INT AS age, repo FROM documents WHERE lower(trim(source)) = 'pull_request'"


def _prs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ci = F.when(i % 4 == 0, "SUCCESS").when(i % 4 == 1, "PENDING").when(i % 4 == 2, "SUCCESS").when(i % 3 == 0, "FAILURE").otherwise("NONE")
    rows = read(spark, d, "documents").where("lower(trim(source)) = 'pull_request'")
    return rows.select("doc_id", F.when(i % 11 == 0, "dev").otherwise("main").alias("base"), ci.alias("ci"), F.when(i % 5 == 0, "APPROVED").when(i % 5 == 1, "CHANGES_REQUESTED").alias("review"), (i % 13 == 0).alias("draft"), F.datediff(F.lit("2026-01-01"), F.to_date("captured_at")).alias("age"), "repo")


@query("q25_review_status", f"SELECT doc_id, CASE WHEN base <> 'main' THEN 'WRONG-BASE' WHEN ci = 'FAILURE' THEN 'CI-FAIL' WHEN review = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN draft THEN 'DRAFT' WHEN age >= 14 THEN 'STALE' WHEN review = 'APPROVED' THEN 'APPROVED' WHEN ci = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status FROM ({PR})")
def review_status(spark, d):
    p = _prs(spark, d)
    return p.select("doc_id", r.pr_status(F.col("base"), "main", F.col("ci"), F.col("review"), F.col("draft"), F.col("age")).alias("status"))


@query("g26_ci_rollup", f"SELECT repo, CASE WHEN bool_or(ci = 'FAILURE') THEN 'FAILURE' WHEN bool_or(ci = 'PENDING') THEN 'PENDING' WHEN bool_or(ci = 'SUCCESS') THEN 'SUCCESS' ELSE 'NONE' END AS ci FROM ({PR}) GROUP BY repo")
def ci_rollup(spark, d):
    has = lambda v: F.bool_or(F.col("ci") == v)
    return _prs(spark, d).groupBy("repo").agg(F.when(has("FAILURE"), "FAILURE").when(has("PENDING"), "PENDING").when(has("SUCCESS"), "SUCCESS").otherwise("NONE").alias("ci"))


@query("k03_cypher", GRAPH + "SELECT edge_id, 'MATCH (a {id: ''' || replace(replace(source, '\\', '\\\\'), '''', '\\''') || '''}), (b {id: ''' || replace(replace(target, '\\', '\\\\'), '''', '\\''') || '''}) MERGE (a)-[:' || upper(regexp_replace(coalesce(relation,'related'), '[^A-Za-z0-9_]', '_', 'g')) || ']->(b);' AS line FROM e")
def cypher(spark, d):
    return export.cypher_edges(edges(spark, d))


@query("s20_node_link_round_trip", GRAPH + "SELECT 'nodes' AS part, id, label, file_type, source_file, coalesce(community, -1)::VARCHAR AS community, NULL::VARCHAR AS source, NULL::VARCHAR AS target, NULL::VARCHAR AS relation, NULL::VARCHAR AS confidence FROM n UNION ALL SELECT 'links', NULL, NULL, NULL, NULL, NULL, source, target, relation, confidence FROM e")
def node_link(spark, d):
    n, links = export.read_node_link(export.node_link(nodes(spark, d), edges(spark, d)))
    n = n.select(F.lit("nodes").alias("part"), "id", "label", "file_type", "source_file", F.coalesce("community", F.lit(-1)).cast("string").alias("community"))
    return n.unionByName(links.select(F.lit("links").alias("part"), "source", "target", "relation", "confidence"), allowMissingColumns=True)


@query("x02_links", "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s\\x0b\\p{Z}\\x{85}<>\"\\)\\]|]+')) AS url FROM documents")
def doc_links(spark, d):
    return text.links(read(spark, d, "documents"), "doc_id", "text")


@query("x02_headings")
def doc_headings(spark, d):
    return text.headings(read(spark, d, "sources").where(F.col("source_file").rlike(r"(?i)\.mdx?$")), "scan_id", "content")


@query("s12_html_text", "SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(text, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), 8000) AS plain FROM documents WHERE contains(text, '</')")
def html_plain(spark, d):
    return read(spark, d, "documents").where(F.col("text").contains("</")).select("doc_id", text.html_text(F.col("text")).alias("plain"))


@query("s11_url_kinds")
def url_kinds(spark, d):
    found = text.links(read(spark, d, "documents"), "doc_id", "text")
    return found.groupBy(r.url_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("f22_defanged", "SELECT doc_id FROM documents WHERE regexp_matches(text, '<\\|[A-Za-z_]+\\|>')")
def defanged(spark, d):
    return read(spark, d, "documents").where(text.defanged(F.col("text")) != F.col("text")).select("doc_id")


@query("x00_extracted_symbols")
def extracted(spark, d):
    found = extractors.extract(read(spark, d, "sources"))
    return found.groupBy("part", "kind").agg(F.count("*").alias("n"))


@query("f14_relation_filter", GRAPH + "SELECT edge_id FROM e WHERE contains(lower(relation), 'import')")
def relation_filter(spark, d):
    return edges(spark, d).where(F.lower("relation").contains("import")).select("edge_id")


@query("q07_neighbours", GRAPH + "SELECT DISTINCT 'out' AS direction, target AS id, relation FROM e WHERE source = (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1) UNION ALL SELECT DISTINCT 'in', source, relation FROM e WHERE target = (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1)")
def around(spark, d):
    e = edges(spark, d)
    return neighbours(e, g.degree(e).orderBy(F.desc("degree"), "id").first().id)


@query("q06_label_matches")
def label_matches(spark, d):
    return searchable(read(spark, d, "nodes")).where(F.col("norm").contains("cache")).select("id").distinct()


@query("j13_trigram_candidates")
def trigram_candidates(spark, d):
    l = searchable(read(spark, d, "nodes")).select("id", F.col("norm").alias("t")).distinct()  # noqa: E741
    postings = l.select("id", "t", F.explode(r.shingles(F.col("t"))).alias("g")).where(F.col("g").isin("cac", "ach", "che"))
    return postings.groupBy("id", "t").agg(F.countDistinct("g").alias("k")).where("k = 3").select("id").distinct()


@query("y30_without_repo", GRAPH + "SELECT id FROM n WHERE repo <> 'ember_crane'")
def without_repo(spark, d):
    return nodes(spark, d).where("repo <> 'ember_crane'").select("id")


@query("y35_suppression_sites", "SELECT scan_id, line FROM (SELECT scan_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM sources WHERE content IS NOT NULL) WHERE regexp_matches(t, '\\bcontinue\\b')")
def sites(spark, d):
    s = read(spark, d, "sources").where("content is not null").select("scan_id", F.posexplode(F.split("content", "\n")).alias("i", "t"))
    return s.where(F.col("t").rlike(r"\bcontinue\b")).select("scan_id", (F.col("i") + 1).cast("long").alias("line"))
