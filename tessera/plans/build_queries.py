"""Queries of the build's identity joins, of row rules, memory documents and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import identity, memory
from tessera.operators import rules as r
from tessera.plans.graph_queries import edges, nodes
from tessera.plans.more_queries import PR, _prs
from tessera.plans.registry import GRAPH, SCORED, query
from tessera.session import read
from tessera.sources import text

# In the tables, nodes of the kind code stand for those that a grammar found.
PARSED = "coalesce(file_type = 'code', FALSE)"
GHOSTS = GRAPH + f""", k AS (SELECT id, trim(label) AS label, split_part(coalesce(source_file, ''), '/', -1) AS name, coalesce(source_file, '') AS file, source_location IS NOT NULL AS located, {PARSED} AS parsed FROM n WHERE trim(label) <> '' AND split_part(coalesce(source_file, ''), '/', -1) <> ''),
a AS (SELECT name, label, count(*) AS c, max(id) AS found FROM k WHERE parsed GROUP BY 1, 2),
x AS (SELECT k.*, a.c, a.found FROM k LEFT JOIN a USING (name, label) WHERE NOT parsed),
y AS (SELECT name, label, coalesce(max(found), min(id) FILTER (located)) AS canon FROM x GROUP BY 1, 2 HAVING coalesce(max(c), 0) < 2 AND count(DISTINCT file) FILTER (located AND (found IS NULL OR id < found)) < 2),
ghost AS (SELECT max(x.id) AS old, y.canon AS new FROM x JOIN y USING (name, label) WHERE x.id <> y.canon GROUP BY name, label, y.canon)
"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).withColumn("parsed", F.coalesce(F.col("file_type") == "code", F.lit(False)))


@query("j03_ghosts", GHOSTS + "SELECT old AS \"end\", new AS id FROM ghost")
def ghosts(spark, d):
    return identity.ghosts(_parsed(spark, d))


@query("j06_remapped_edges", GHOSTS + """, o AS (SELECT DISTINCT edge_id, source, target FROM edges WHERE source IS NOT NULL AND target IS NOT NULL),
m AS (SELECT edge_id, source, target, coalesce(a.new, source) AS s, coalesce(b.new, target) AS t FROM o LEFT JOIN ghost a ON a.old = source LEFT JOIN ghost b ON b.old = target)
SELECT edge_id, s AS source, t AS target FROM m WHERE s <> t OR source = target""")
def remapped_edges(spark, d):
    once = read(spark, d, "edges").select("edge_id", "source", "target").where("source is not null and target is not null").distinct()
    return identity.remapped(once, identity.ghosts(_parsed(spark, d)))


@query("j02_resolved_endpoints")
def resolved_endpoints(spark, d):
    return identity.resolved_endpoints(read(spark, d, "edges"), read(spark, d, "nodes"))


@query("j04_doc_twins", GRAPH + "SELECT b.id AS \"end\", a.id AS id FROM n a JOIN n b ON a.id = b.id || '_doc' AND a.source_file = b.source_file WHERE a.file_type = 'document' AND b.file_type = 'document' AND a.source_file <> ''")
def doc_twins(spark, d):
    return identity.doc_twins(nodes(spark, d))


_SEGMENTS = "list_filter(list_transform(string_split(regexp_replace(replace(coalesce(source_file, ''), '\\', '/'), '\\.[^./]+$', ''), '/'), lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g'), '_')), lambda p: p <> '')"
_ID = "trim(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '_')"
_DEFINES = f"({_ID} <> '' AND coalesce(list_bool_or(list_transform(range(1, len({_SEGMENTS}) + 1), lambda i: {_ID} = array_to_string(list_slice({_SEGMENTS}, i, len({_SEGMENTS})), '_') OR starts_with({_ID}, array_to_string(list_slice({_SEGMENTS}, i, len({_SEGMENTS})), '_') || '_'))), FALSE))"


@query("g05_survivors", f"SELECT id, label, source_file FROM (SELECT id, coalesce(label, '') AS label, coalesce(source_file, '') AS source_file, row_number() OVER (PARTITION BY id ORDER BY NOT {_DEFINES}, length(coalesce(label, '')), coalesce(label, ''), coalesce(source_file, '')) AS rk FROM nodes WHERE id IS NOT NULL) WHERE rk = 1")
def collision_survivors(spark, d):
    return identity.survivors(read(spark, d, "nodes"))


@query("g06_definers", f"SELECT seq FROM nodes WHERE id IS NOT NULL AND {_DEFINES}")
def definers(spark, d):
    return read(spark, d, "nodes").where(identity.defines_id(F.col("id"), F.coalesce("source_file", F.lit("")))).select("seq")


_TEST = "(regexp_matches({0}, '(?i)(^|/)(tests?|specs?|__tests__)(/|$)') OR regexp_matches(split_part({0},'/',-1), '(?i)^test_|_test\\..+$|\\.test\\..+$|\\.spec\\..+$|_spec\\..+$|\\.tests\\.ps1$') OR regexp_matches(split_part({0},'/',-1), 'Tests?\\.java$|Tests\\.cs$'))"
_DIR = "list_slice(string_split({0}, '/'), 1, len(string_split({0}, '/')) - 1)"


@query("j16_namesakes", GRAPH + f""", c AS (SELECT regexp_replace(lower(label), '\\(\\)$', '') AS name, id, regexp_replace(replace(coalesce(source_file, ''), '\\', '/'), '^(\\./|/)+', '') AS file FROM n WHERE label IS NOT NULL),
ct AS (SELECT *, {_TEST.format('file')} AS test FROM c WHERE name <> ''),
q AS (SELECT DISTINCT e.source_file AS qfile, c.name FROM e JOIN c ON c.id = e.target WHERE e.relation = 'calls' AND e.source_file IS NOT NULL),
qt AS (SELECT q.*, {_TEST.format('qfile')} AS in_test, (SELECT count(*) FROM ct WHERE ct.name = q.name) AS total, (SELECT count(*) FROM ct WHERE ct.name = q.name AND test) AS tests FROM q),
near AS (SELECT qfile, qt.name, total, id, file, CASE WHEN file = qfile THEN 1000000 WHEN {_DIR.format('file')} = {_DIR.format('qfile')} THEN 900000 ELSE (SELECT count(*) FROM range(1, least(len({_DIR.format('file')}), len({_DIR.format('qfile')})) + 1) t(i) WHERE list_slice({_DIR.format('file')}, 1, i) = list_slice({_DIR.format('qfile')}, 1, i)) END AS steps FROM qt JOIN ct ON ct.name = qt.name AND (total = 1 OR test = (in_test AND tests > 0))),
w AS (SELECT qfile, name, count(*) AS kept, min(id) AS one, max(steps) AS best FROM near GROUP BY 1, 2)
SELECT qfile AS file, name, id FROM (SELECT w.qfile, w.name, CASE WHEN kept = 1 THEN one ELSE (SELECT CASE WHEN count(*) = 1 AND best > 0 THEN min(id) END FROM near WHERE near.qfile = w.qfile AND near.name = w.name AND near.steps = best) END AS id FROM w) WHERE id IS NOT NULL""")
def namesakes(spark, d):
    n = nodes(spark, d)
    names = n.select(F.col("id").alias("target"), r.bare_name(F.col("label")).alias("name"))
    calls = edges(spark, d).where("relation = 'calls' and source_file is not null").join(names, "target").select(F.col("source_file").alias("file"), "name")
    return identity.namesakes(calls, n)


@query("u06_matched_communities")
def matched_communities(spark, d):
    state = lambda when: g.latest_nodes(read(spark, d, "nodes").where(when)).where("community is not null").select("id", "community")
    return identity.matched_communities(state("captured_at >= timestamp_ntz'2025-03-01'"), state("captured_at < timestamp_ntz'2025-06-01' or captured_at is null"))


# row rules

@query("p20_callable_names", "SELECT seq, lower(regexp_replace(regexp_replace(trim(label), '^[()]+|[()]+$', '', 'g'), '^\\.+', '')) AS name FROM nodes")
def callable_names(spark, d):
    return read(spark, d, "nodes").select("seq", r.callable_name(F.col("label")).alias("name"))


@query("p22_salts", "SELECT DISTINCT source_file, left(sha1(source_file), 6) AS salt FROM sources WHERE source_file IS NOT NULL")
def salts(spark, d):
    return read(spark, d, "sources").where("source_file is not null").select("source_file", F.substring(F.sha1(F.encode("source_file", "UTF-8")), 1, 6).alias("salt")).distinct()


@query("p18_costs", "SELECT source, round(sum(tokens) * 3.0 / 1e6, 9) AS cost FROM (SELECT lower(trim(source)) AS source, greatest(1, length(text) // 4) AS tokens FROM documents WHERE text IS NOT NULL) GROUP BY source")
def costs(spark, d):
    docs = read(spark, d, "documents").where("text is not null").groupBy(F.lower(F.btrim("source")).alias("source"))
    return docs.agg(F.round(F.sum(r.estimated_tokens(F.col("text"))) * 3.0 / 1e6, 9).alias("cost"))


_ENDS = " OR ".join(f"ends_with(trim(label), '{x}')" for x in (".py", ".js", ".ts", ".tsx", ".java", ".go", ".rs"))


@query("f16_resolvable", GRAPH + f"SELECT id FROM n WHERE file_type = 'code' AND trim(label) <> '' AND NOT ({_ENDS}) AND regexp_replace(regexp_replace(trim(label), '^[()]+|[()]+$', '', 'g'), '^\\.+', '') <> ''")
def resolvable(spark, d):
    return nodes(spark, d).where(r.is_resolvable(F.col("file_type"), F.col("label"))).select("id")


@query("f08_json_keys", "SELECT seq FROM nodes WHERE ends_with(lower(source_file), '.json') AND lower(trim(label)) IN ('start','end','name','id','type','properties','value','key','data','items','title','description','version','dependencies','devdependencies','peerdependencies','optionaldependencies','bundleddependencies','bundledependencies')")
def json_keys(spark, d):
    return read(spark, d, "nodes").where(r.is_json_key(F.col("source_file"), F.col("label"))).select("seq")


_LOW = "lower(CASE WHEN coalesce(label, '') = '' THEN coalesce(id, '') ELSE label END)"
_FILE = "lower(coalesce(source_file, ''))"


@query("y44_node_kinds", f"""SELECT seq, CASE WHEN lower(coalesce(file_type, '')) IN ('rationale', 'document') THEN 'concept' WHEN contains({_FILE}, 'test') OR starts_with({_LOW}, 'test_') OR contains({_FILE}, 'spec') THEN 'test'
 WHEN regexp_matches({_LOW}, 'endpoint|router|api|route') THEN 'api' WHEN regexp_matches({_LOW}, 'cli|command|click|typer') THEN 'entry' WHEN regexp_matches({_LOW}, 'async|await|stream|sse') THEN 'async'
 WHEN regexp_matches({_LOW}, 'component|props|hook|store') OR regexp_matches(label, '^use[A-Z_-]') OR regexp_matches({_FILE}, '\\.(tsx|jsx|vue|svelte)$') THEN 'ui'
 WHEN regexp_matches(label, '^[A-Z]') AND NOT ends_with(label, '()') THEN 'klass' WHEN regexp_matches(label, '\\.(py|ts|tsx|js|jsx|go|rs|java|kt|rb|php|cs|swift|vue|svelte)$') THEN 'module' ELSE 'function' END AS kind FROM nodes""")
def node_kinds(spark, d):
    return read(spark, d, "nodes").select("seq", r.node_kind(F.col("id"), F.col("label"), F.col("source_file"), F.col("file_type")).alias("kind"))


@query("y44_relation_words", "SELECT DISTINCT relation, CASE trim(relation) WHEN 'imports_from' THEN 'imports' WHEN 'rationale_for' THEN 'explains' WHEN 'conceptually_related_to' THEN 'relates' WHEN 'participate_in' THEN 'joins' WHEN 'form' THEN 'forms' ELSE replace(trim(coalesce(relation, '')), '_', ' ') END AS word FROM edges")
def relation_words(spark, d):
    return read(spark, d, "edges").select("relation").distinct().select("relation", r.relation_word(F.col("relation")).alias("word"))


@query("f21_public_urls", "WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'https?://[^\\s\\x0b\\p{Z}\\x{85}<>\"\\)\\]|]+')) AS url FROM documents), h AS (SELECT url, lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM u) SELECT url, host <> '' AND NOT regexp_matches(host, '^(localhost|.*\\.localhost|.*\\.local|metadata\\.google\\.internal)$|^(127|10|0)\\.|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.') AS public FROM h")
def public_urls(spark, d):
    urls = text.links(read(spark, d, "documents"), "doc_id", "text").select("url").distinct()
    return urls.select("url", r.is_public_url(F.col("url")).alias("public"))


@query("y45_common_roots", "WITH f AS (SELECT DISTINCT repo, string_split(source_file, '/') AS p FROM sources WHERE repo IS NOT NULL), x AS (SELECT repo, min(p) AS a, max(p) AS b FROM f GROUP BY repo) SELECT repo, array_to_string(list_slice(a, 1, coalesce((SELECT min(i) - 1 FROM range(1, least(len(a), len(b))) t(i) WHERE a[i] <> b[i]), least(len(a), len(b)) - 1)), '/') AS root FROM x")
def common_roots(spark, d):
    # the least and the greatest path part where any two do
    parts = read(spark, d, "sources").where("repo is not null").select("repo", F.split("source_file", "/").alias("p"))
    ends = parts.groupBy("repo").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    most = F.least(F.size("a"), F.size("b")) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.get("a", i - 1) == F.get("b", i - 1))
    length = F.least(F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(most), most).cast("int")
    return ends.select("repo", F.array_join(F.slice("a", F.lit(1), F.greatest(length, F.lit(0))), "/").alias("root"))


@query("g30_files", GRAPH + "SELECT coalesce(nullif(source_file, ''), 'unknown') AS file, count(*) AS nodes FROM n GROUP BY 1")
def files(spark, d):
    return nodes(spark, d).groupBy(F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.lit("unknown")).alias("file")).agg(F.count("*").alias("nodes"))


@query("g24_community_labels", GRAPH + "SELECT community, string_agg(label, '|' ORDER BY rk) AS labels FROM (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY id) AS rk FROM n WHERE community IS NOT NULL AND label IS NOT NULL) WHERE rk <= 4 GROUP BY community")
def community_labels(spark, d):
    few = g.top_k(nodes(spark, d).where("community is not null and label is not null"), ["community"], [F.col("id")], 4)
    return few.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), "|").alias("labels"))  # four each


@query("g25_contested_communities", GRAPH + f", c AS (SELECT DISTINCT repo, community FROM n WHERE repo IS NOT NULL AND community IS NOT NULL), reviews AS (SELECT repo, count(*) AS prs FROM ({PR}) WHERE repo IS NOT NULL GROUP BY repo) SELECT community, sum(prs)::BIGINT AS prs FROM c JOIN reviews USING (repo) GROUP BY community HAVING sum(prs) > 1")
def contested(spark, d):
    # reviews are counted per repository before they meet its communities
    prs = _prs(spark, d).where("repo is not null").groupBy("repo").agg(F.count("*").alias("prs"))
    touched = nodes(spark, d).where("repo is not null and community is not null").select("repo", "community").distinct()
    return touched.join(prs, "repo").groupBy("community").agg(F.sum("prs").alias("prs")).where("prs > 1")


@query("t08_triage", f"SELECT doc_id, list_position(['WRONG-BASE','CI-FAIL','CHANGES-REQ','DRAFT','STALE','APPROVED','PENDING','READY'], CASE WHEN base <> 'main' THEN 'WRONG-BASE' WHEN ci = 'FAILURE' THEN 'CI-FAIL' WHEN review = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN draft THEN 'DRAFT' WHEN age >= 14 THEN 'STALE' WHEN review = 'APPROVED' THEN 'APPROVED' WHEN ci = 'PENDING' THEN 'PENDING' ELSE 'READY' END)::BIGINT AS place FROM ({PR})")
def triage(spark, d):
    status = r.pr_status(F.col("base"), "main", F.col("ci"), F.col("review"), F.col("draft"), F.col("age"))
    return _prs(spark, d).select("doc_id", F.array_position(F.array(*map(F.lit, r.STATUS_ORDER)), status).alias("place"))


@query("u01_fragments", "SELECT id, label, file_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen DESC, seq DESC) AS rk FROM (SELECT id, label, file_type, coalesce(captured_at, TIMESTAMP '0001-01-01') AS seen, seq FROM nodes UNION ALL SELECT id, label, file_type, TIMESTAMP '0001-01-01', -1 FROM shared_nodes) WHERE id IS NOT NULL) WHERE rk = 1")
def fragments(spark, d):
    shared = read(spark, d, "shared_nodes").withColumn("seq", F.lit(-1).cast("long"))
    return g.latest_nodes(read(spark, d, "nodes").unionByName(shared, allowMissingColumns=True)).select("id", "label", "file_type")


@query("u04_merged_graphs", "WITH o AS (SELECT id, max_by(label, seq) AS label FROM nodes WHERE id IS NOT NULL AND (captured_at < TIMESTAMP '2025-06-01' OR captured_at IS NULL) GROUP BY id), t AS (SELECT id, max_by(label, seq) AS label FROM nodes WHERE id IS NOT NULL AND captured_at >= TIMESTAMP '2025-03-01' GROUP BY id) SELECT coalesce(t.id, o.id) AS id, CASE WHEN t.id IS NULL THEN o.label ELSE t.label END AS label, CASE WHEN t.id IS NULL THEN 'ours' WHEN o.id IS NULL THEN 'theirs' ELSE 'both' END AS side FROM o FULL JOIN t ON o.id = t.id")
def merged_graphs(spark, d):
    """Union of two states of a graph by id; where both have it, theirs counts."""
    n = read(spark, d, "nodes").where("id is not null")
    last = lambda df: df.groupBy("id").agg(F.max_by(F.struct("label"), "seq").alias("x"))
    ours, theirs = last(n.where("captured_at < timestamp_ntz'2025-06-01' or captured_at is null")).withColumnRenamed("x", "a"), last(n.where("captured_at >= timestamp_ntz'2025-03-01'")).withColumnRenamed("x", "b")
    side = F.when(F.col("b").isNull(), "ours").when(F.col("a").isNull(), "theirs").otherwise("both")
    return ours.join(theirs, "id", "full").select("id", F.coalesce("b", "a")["label"].alias("label"), side.alias("side"))


@query("u05_attached_groups", "WITH s AS (SELECT l_orderkey AS id, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'), a AS (SELECT l_orderkey AS id, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM s)) SELECT id, count(DISTINCT l_partkey) AS members, 'stored' AS origin FROM s GROUP BY id UNION ALL SELECT id, count(DISTINCT l_partkey), 'added' FROM a GROUP BY id")
def attached_groups(spark, d):
    """Groups (the parts of an order) appended to those there are; a group whose id is known is not taken again."""
    from tessera.operators.incremental import append_unseen

    groups = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_partkey").alias("members"))
    finished = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return append_unseen(groups.join(finished, "id", "left_semi").withColumn("origin", F.lit("stored")), groups.withColumn("origin", F.lit("added")), "id")


@query("u11_uncovered", "SELECT DISTINCT source_file FROM sources WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT regexp_replace(replace(source_file, '\\', '/'), '^(\\./|/)+', '') FROM nodes WHERE source_file IS NOT NULL AND file_type = 'code')")
def uncovered(spark, d):
    """Files sent for extraction of which no code node came back."""
    covered = read(spark, d, "nodes").where("file_type = 'code'").select(r.slashes(F.col("source_file")).alias("source_file"))
    return read(spark, d, "sources").where("source_file is not null").select("source_file").distinct().join(covered, "source_file", "left_anti")


@query("y06_owners", "SELECT DISTINCT regexp_replace(replace(source_file, '\\', '/'), '^(\\./|/)+', '') AS owner FROM nodes WHERE trim(source_file) <> ''")
def owners(spark, d):
    return read(spark, d, "nodes").where("btrim(source_file) <> ''").select(r.slashes(F.col("source_file")).alias("owner")).distinct()


@query("y36_extra_edges", "SELECT sum(c - 1)::BIGINT AS extra FROM (SELECT count(*) AS c FROM edges GROUP BY source, target, relation, confidence, confidence_score, weight, context, source_file)")
def extra_edges(spark, d):
    """Deliveries beyond the first of edges that are equal in all but their number and times."""
    e = read(spark, d, "edges").groupBy("source", "target", "relation", "confidence", "confidence_score", "weight", "context", "source_file").agg(F.count("*").alias("c"))
    return e.agg(F.sum(F.col("c") - 1).alias("extra"))


@query("y22_file_nodes", GRAPH + ", x AS (SELECT source_file AS file, id, source_location = 'L1' AS top, lower(label) = lower(split_part(source_file, '/', -1)) AS named FROM n WHERE source_file <> '') SELECT file, CASE WHEN count(*) FILTER (top AND named) = 1 THEN min(id) FILTER (top AND named) WHEN count(*) FILTER (top) = 1 THEN min(id) FILTER (top) WHEN count(*) FILTER (named) = 1 THEN min(id) FILTER (named) END AS id FROM x GROUP BY file")
def file_nodes(spark, d):
    """The node that stands for a file: the only one at line 1 with its name, at line 1, or with its name."""
    top, label = F.coalesce(F.col("source_location") == "L1", F.lit(False)), F.lower("label")
    named = F.coalesce(label == F.lower(r.basename(F.col("source_file"))), F.lit(False))
    x = nodes(spark, d).where("source_file <> ''").select(F.col("source_file").alias("file"), "id", top.alias("top"), named.alias("named"))
    only = lambda when: F.when(F.count_if(when) == 1, F.min(F.when(when, F.col("id"))))
    return x.groupBy("file").agg(F.coalesce(only(F.col("top") & F.col("named")), only(F.col("top")), only(F.col("named"))).alias("id"))


# memory documents

MEMORY = """SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^date:[ \\t]*"?([^"\\n]*)"?[ \\t]*$', 1)), '') AS date, nullif(trim(regexp_extract(text, '(?m)^outcome:[ \\t]*"?([^"\\n]*)"?[ \\t]*$', 1)), '') AS outcome, list_filter(list_transform(string_split(regexp_extract(text, '(?m)^source_nodes:[ \\t]*\\[([^\\]]*)\\]', 1), ','), lambda x: trim(x, ' "''')), lambda x: x <> '') AS source_nodes FROM documents WHERE starts_with(text, '---')"""


def _memory(spark: SparkSession, d: str) -> DataFrame:
    return text.front_matter(read(spark, d, "documents").where(F.col("text").startswith("---")).select("doc_id", "text"), "text")


@query("s21_memory_documents", f"SELECT doc_id, date, outcome, len(source_nodes) AS cited FROM ({MEMORY})")
def memory_documents(spark, d):
    return _memory(spark, d).select("doc_id", "date", "outcome", F.size("source_nodes").cast("long").alias("cited"))


@query("j26_citations", GRAPH + f", m AS (SELECT doc_id, outcome, unnest(source_nodes) AS node FROM ({MEMORY})), l AS (SELECT label AS node, min(id) AS id FROM n WHERE label IS NOT NULL GROUP BY label HAVING count(*) = 1) SELECT doc_id, m.node, outcome, coalesce(n.id, l.id) AS id FROM m LEFT JOIN n ON n.id = m.node LEFT JOIN l ON l.node = m.node")
def citations(spark, d):
    rows = _memory(spark, d).select("doc_id", "outcome", F.explode("source_nodes").alias("node"))
    return identity.cited(rows, nodes(spark, d)).select("doc_id", "node", "outcome", "id")


@query("y24_finished_lessons", f"SELECT node, score, CASE WHEN pos >= 2 AND neg = 0 THEN 'preferred' WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos > 0 THEN 'tentative' ELSE 'avoided' END AS bucket FROM (SELECT node, round(sum((CASE outcome WHEN 'useful' THEN 1 WHEN 'dead_end' THEN -1 ELSE 0 END) * pow(0.5, greatest(date_diff('day', date::DATE, DATE '2026-01-01'), 0) / 30.0)), 9) AS score, count(*) FILTER (outcome = 'useful') AS pos, count(*) FILTER (outcome = 'dead_end') AS neg FROM (SELECT date, outcome, unnest(source_nodes) AS node FROM ({MEMORY})) GROUP BY node)")
def finished_lessons(spark, d):
    rows = _memory(spark, d).select("date", "outcome", F.explode("source_nodes").alias("node"))
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome") == "dead_end", -1).otherwise(0)
    age = F.greatest(F.datediff(F.lit("2026-01-01").cast("date"), memory.day(F.col("date"))), F.lit(0))  # without a day, in full
    made = rows.groupBy("node").agg(F.round(F.sum(sign * F.pow(F.lit(0.5), age / 30.0)), 9).alias("score"), F.count_if(sign > 0).alias("pos"), F.count_if(sign < 0).alias("neg"))
    bucket = F.when((F.col("pos") >= 2) & (F.col("neg") == 0), "preferred").when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") > 0, "tentative").otherwise("avoided")
    return made.select("node", "score", bucket.alias("bucket"))


# renderings, as rows that Spark's text sink writes

_Q = "replace(replace(coalesce({0}, ''), '\\', '\\\\'), '''', '\\''')"
_X = "replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


def _xml(c: str):
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


@query("k03_cypher_nodes", GRAPH + f"SELECT id, 'MERGE (n:' || CASE WHEN regexp_matches(coalesce(file_type, ''), '^[A-Za-z][A-Za-z0-9_]*$') THEN upper(left(file_type, 1)) || lower(substr(file_type, 2)) ELSE 'Entity' END || ' {{id: ''' || {_Q.format('id')} || ''', label: ''' || {_Q.format('label')} || '''}});' AS line FROM n")
def cypher_nodes(spark, d):
    from tessera.operators.export import _quoted

    kind = F.when(F.coalesce("file_type", F.lit("")).rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.concat(F.upper(F.substring("file_type", 1, 1)), F.lower(F.substring("file_type", 2, 1 << 20)))).otherwise("Entity")
    return nodes(spark, d).select("id", F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), _quoted(F.col("id")), F.lit(", label: "), _quoted(F.col("label")), F.lit("});")).alias("line"))


@query("k05_graphml_edges", SCORED + f"SELECT edge_id, '<edge source=\"' || {_X.format('source')} || '\" target=\"' || {_X.format('target')} || '\"><data key=\"relation\">' || {_X.format('relation')} || '</data><data key=\"confidence\">' || {_X.format('conf')} || '</data></edge>' AS line FROM s")
def graphml_edges(spark, d):
    from tessera.plans.graph_queries import scored

    parts = [F.lit('<edge source="'), _xml("source"), F.lit('" target="'), _xml("target"), F.lit('"><data key="relation">'), _xml("relation"), F.lit('</data><data key="confidence">'), _xml("conf"), F.lit("</data></edge>")]
    return scored(spark, d).select("edge_id", F.concat(*parts).alias("line"))


@query("k06_notes", SCORED + ", k AS (SELECT id, conf, count(*) AS c FROM (SELECT source AS id, conf FROM s UNION ALL SELECT target, conf FROM s) GROUP BY id, conf), d AS (SELECT id, sum(c)::BIGINT AS links, arg_min(conf, (-c, conf)) AS mostly FROM k GROUP BY id), f AS (SELECT id, regexp_replace(coalesce(label, id), '[\\\\/*?:\"<>|#^\\[\\]]', '', 'g') AS name FROM n) SELECT f.id, CASE WHEN count(*) OVER (PARTITION BY lower(name)) = 1 THEN name ELSE name || '_' || left(md5(f.id), 12) END AS note, coalesce(links, 0) AS links, coalesce(mostly, 'EXTRACTED') AS mostly FROM f LEFT JOIN d USING (id)")
def notes(spark, d):
    """One note per node: a file name that no other has in whatever case, its links and their most frequent
    confidence. Names that repeat get a part of the id's hash, so that namesakes need not meet."""
    from tessera.plans.graph_queries import scored

    n = nodes(spark, d).select("id", F.regexp_replace(F.coalesce("label", "id"), r'[\\/*?:"<>|#^\[\]]', "").alias("name")).withColumn("low", F.lower("name"))
    repeated = n.groupBy("low").agg(F.count("*").alias("k")).where("k > 1").select("low", F.lit(True).alias("repeated"))
    note = F.when(F.col("repeated"), F.concat_ws("_", "name", F.substring(F.md5(F.encode("id", "UTF-8")), 1, 12))).otherwise(F.col("name"))
    ends = scored(spark, d).select(F.explode(F.array("source", "target")).alias("id"), "conf").groupBy("id", "conf").agg(F.count("*").alias("c"))
    links = ends.groupBy("id").agg(F.sum("c").alias("links"), F.min_by("conf", F.struct(-F.col("c"), F.col("conf"))).alias("mostly"))
    return n.join(repeated, "low", "left").join(links, "id", "left").select("id", note.alias("note"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("mostly", F.lit("EXTRACTED")).alias("mostly"))


@query("k13_report", SCORED + """, c AS (SELECT community, count(*) AS m FROM n WHERE community IS NOT NULL GROUP BY community), k AS (SELECT conf, count(*) AS c, avg(score) AS mean FROM s GROUP BY conf)
SELECT 'summary' AS section, (SELECT count(*) FROM n) || ' nodes, ' || (SELECT count(*) FROM e) || ' edges, ' || (SELECT count(*) FROM c) || ' communities (' || (SELECT count(*) FROM c WHERE m < 3) || ' thin)' AS line
UNION ALL SELECT 'confidence', conf || ': ' || round(100.0 * c / (SELECT sum(c) FROM k))::INT || '%' FROM k UNION ALL SELECT 'inferred', 'average score ' || round(mean, 2)::DECIMAL(10, 2) FROM k WHERE conf = 'INFERRED'
UNION ALL SELECT 'isolated', count(*) || ' nodes without a link' FROM n WHERE id NOT IN (SELECT id FROM deg)""")
def report(spark, d):
    """Lines of the report's sections, each from an aggregate of a few rows."""
    from tessera.plans.graph_queries import scored

    n, s = nodes(spark, d), scored(spark, d)
    sizes = n.where("community is not null").groupBy("community").agg(F.count("*").alias("m")).agg(F.count("*").alias("c"), F.count_if(F.col("m") < 3).alias("thin"))
    kinds = s.groupBy("conf").agg(F.count("*").alias("c"), F.avg("score").alias("mean"))
    whole = kinds.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
    one = n.agg(F.count("*").alias("n")).crossJoin(whole).crossJoin(sizes)  # three tables of one row
    summary = one.select(F.lit("summary").alias("section"), F.concat_ws("", "n", F.lit(" nodes, "), "all", F.lit(" edges, "), "c", F.lit(" communities ("), "thin", F.lit(" thin)")).alias("line"))
    shares = kinds.crossJoin(whole).select(F.lit("confidence"), F.concat("conf", F.lit(": "), F.round(100.0 * F.col("c") / F.col("all")).cast("int").cast("string"), F.lit("%")))
    inferred = kinds.where("conf = 'INFERRED'").select(F.lit("inferred"), F.concat(F.lit("average score "), F.round("mean", 2).cast("decimal(10,2)").cast("string")))
    alone = n.join(g.degree(edges(spark, d)), "id", "left_anti").agg(F.count("*").alias("k")).select(F.lit("isolated"), F.concat(F.col("k").cast("string"), F.lit(" nodes without a link")))
    return summary.union(shares).union(inferred).union(alone)
