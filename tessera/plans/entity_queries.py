"""Queries of entity resolution, communities, node lookup, articles and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import communities, dedup, export
from tessera.operators import graph as g
from tessera.operators import rules as r
from tessera.operators.search import searchable
from tessera.plans.graph_queries import REAL, SIDES, cohesion, edges, nodes, with_files
from tessera.plans.registry import GRAPH, query
from tessera.session import read


FILE_NODE = REAL.split(" AND NOT (coalesce(source_file")[0]


@query("j12_entities")
def entities(spark, d):
    return dedup.entities(nodes(spark, d))


@query("q12_communities")
def detected(spark, d):
    return communities.detect(nodes(spark, d), edges(spark, d))


@query("p02_label_keys")
def label_keys(spark, d):
    from tessera.functions.ids import label_key

    return read(spark, d, "nodes").where("label is not null").select(label_key(F.col("label")).alias("key")).distinct()


@query("p01_normal_ids")
def normal_ids(spark, d):
    from tessera.functions.ids import normalize_id

    return read(spark, d, "nodes").where("id is not null").select(normalize_id(F.col("id")).alias("id")).distinct()


@query("q05_find_node")
def find_node(spark, d):
    n = searchable(read(spark, d, "nodes").where("id is not null")).select("id", F.col("norm").alias("t"), F.col("file").alias("f"))
    tier = F.when(F.col("f") == "cache", 0).when(F.col("t") == "cache", 1).when(F.col("t").startswith("cache"), 2).when(F.col("t").contains("cache"), 3)
    return n.select("id", tier.alias("tier")).where("tier is not null").distinct()


@query("y39_article_neighbours", GRAPH + ", hub AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 10), x AS (SELECT source AS hub, relation, target AS other FROM e WHERE source IN (SELECT id FROM hub) UNION SELECT target, relation, source FROM e WHERE target IN (SELECT id FROM hub)) SELECT hub, relation, other, place FROM (SELECT x.*, row_number() OVER (PARTITION BY hub, relation ORDER BY degree DESC, other) AS place FROM x JOIN deg ON deg.id = x.other) WHERE place <= 20")
def article_neighbours(spark, d):
    e = edges(spark, d)
    deg = g.degree(e)
    hubs = deg.orderBy(F.desc("degree"), "id").limit(10).select(F.col("id").alias("hub"))
    out = e.select(F.explode(F.array(F.struct(F.col("source").alias("hub"), "relation", F.col("target").alias("other")), F.struct(F.col("target").alias("hub"), "relation", F.col("source").alias("other")))).alias("x")).select("x.*")
    near = out.join(F.broadcast(hubs), "hub", "left_semi").distinct().join(deg.withColumnRenamed("id", "other"), "other")  # ten hubs
    return g.top_k(near, ["hub", "relation"], [F.desc("degree"), F.col("other")], 20).select("hub", "relation", "other", F.col("rank").cast("long").alias("place"))


@query("q20_questions", SIDES + f""", a AS (SELECT n.id, n.label, n.source_file, n.file_type, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg USING (id)),
t AS (SELECT id FROM a WHERE {FILE_NODE} ORDER BY degree DESC, id LIMIT 5),
v AS (SELECT t.id FROM t JOIN w ON (w.source = t.id OR w.target = t.id) AND conf = 'INFERRED' GROUP BY t.id HAVING count(*) >= 2),
i AS (SELECT x.community, count(*) AS inside FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE x.community = y.community GROUP BY 1),
c AS (SELECT community FROM (SELECT community, count(*) AS m FROM n WHERE community IS NOT NULL GROUP BY community) LEFT JOIN i USING (community) WHERE m >= 5 AND coalesce(inside, 0) / (m * (m - 1) / 2.0) < 0.15),
q AS (SELECT 1 AS generator, edge_id::VARCHAR AS subject FROM w WHERE conf = 'AMBIGUOUS' UNION ALL SELECT 2, id FROM deg WHERE degree >= 20 UNION ALL SELECT 3, id FROM v
 UNION ALL SELECT 4, id FROM a WHERE degree <= 1 AND {REAL} AND coalesce(file_type, '') <> 'rationale' UNION ALL SELECT 5, community::VARCHAR FROM c) SELECT generator, count(*) AS n, min(subject) AS first FROM q GROUP BY generator""")
def questions(spark, d):
    """Unclear edges, bridges (by degree), much-linked nodes with inferred edges, loose nodes, communities of low cohesion."""
    e, n = with_files(spark, d), nodes(spark, d)
    rows = n.join(g.degree(edges(spark, d)), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    subject = lambda df, k, c: df.select(F.lit(k).alias("generator"), F.col(c).cast("string").alias("subject"))
    unsure = subject(e.where("conf = 'AMBIGUOUS'"), 1, "edge_id")
    bridges = subject(rows.where("degree >= 20"), 2, "id")
    file_node = r.is_file_node(F.col("label"), F.col("source_file"), F.col("degree"))
    top = rows.where(~file_node).orderBy(F.desc("degree"), "id").limit(5).select("id")
    ends = F.explode(F.array_distinct(F.array("source", "target"))).alias("id")
    doubted = e.where("conf = 'INFERRED'").select(ends).join(F.broadcast(top), "id", "left_semi").groupBy("id").agg(F.count("*").alias("k")).where("k >= 2")  # five nodes
    loose = rows.where((F.col("degree") <= 1) & ~file_node & ~r.is_concept_node(F.col("source_file")) & (F.coalesce("file_type", F.lit("")) != "rationale"))
    thin = cohesion(spark, d).where("n >= 5 and cohesion < 0.15")
    out = unsure.unionByName(bridges).unionByName(subject(doubted, 3, "id")).unionByName(subject(loose, 4, "id")).unionByName(subject(thin, 5, "community"))
    return out.groupBy("generator").agg(F.count("*").alias("n"), F.min("subject").alias("first"))


@query("q22_sections", "WITH k AS (SELECT * FROM (VALUES ('storage','cache'),('storage','store'),('parsing','parse'),('parsing','token'),('graph','graph'),('graph','edge'),('graph','node')) t(section, word)), n AS (SELECT DISTINCT id, lower(label) AS t FROM nodes WHERE label IS NOT NULL), s AS (SELECT id, section, count(*) AS hits FROM n JOIN k ON contains(t, word) GROUP BY id, section) SELECT id, section FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, section) AS rk FROM s) WHERE rk = 1")
def sections(spark, d):
    words = {"storage": ["cache", "store"], "parsing": ["parse", "token"], "graph": ["graph", "edge", "node"]}
    n = read(spark, d, "nodes").where("label is not null").select("id", F.lower("label").alias("t")).distinct()
    hits = F.array(*(F.struct((-F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.col("t").contains(w)))).alias("less"), F.lit(name).alias("section")) for name, ws in words.items()))
    per = n.select("id", F.explode(hits).alias("x")).select("id", "x.*").groupBy("id", "section").agg(F.sum("less").alias("less")).where("less < 0")
    return per.groupBy("id").agg(F.min_by("section", F.struct("less", "section")).alias("section"))


@query("w06_ambiguity", GRAPH + f"SELECT community, id, degree, next FROM (SELECT community, n.id, degree, lead(degree) OVER (PARTITION BY community ORDER BY degree DESC, n.id) AS next, row_number() OVER (PARTITION BY community ORDER BY degree DESC, n.id) AS rk FROM n JOIN deg USING (id) WHERE community IS NOT NULL) WHERE rk = 1 AND next IS NOT NULL")
def ambiguity(spark, d):
    n = nodes(spark, d).where("community is not null").join(g.degree(edges(spark, d)), "id")
    two = g.top_k(n, ["community"], [F.desc("degree"), F.col("id")], 2)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    return two.groupBy("community").agg(first("id").alias("id"), first("degree").alias("degree"), F.max(F.when(F.col("rank") == 2, F.col("degree"))).alias("next")).where("next is not null")


@query("k05_graphml_nodes", GRAPH + "SELECT id, '<node id=\"' || replace(replace(replace(id, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') || '\"><data key=\"community\">' || coalesce(community, -1) || '</data></node>' AS line FROM n")
def graphml(spark, d):
    safe = F.replace(F.replace(F.replace(F.col("id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return nodes(spark, d).select("id", F.concat(F.lit('<node id="'), safe, F.lit('"><data key="community">'), F.coalesce(F.col("community").cast("string"), F.lit("-1")), F.lit("</data></node>")).alias("line"))


@query("f05_sentence_labels", "SELECT seq FROM nodes WHERE (length(label) >= 80 OR len(string_split(label, ' ')) >= 8) AND regexp_matches(label, '[.!?:]')")
def sentence_labels(spark, d):
    lab = F.col("label")
    return read(spark, d, "nodes").where(((F.length(lab) >= 80) | (F.size(F.split(lab, " ")) >= 8)) & lab.rlike("[.!?:]")).select("seq")


@query("g14_confidence_report", SIDES + "SELECT conf, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM w GROUP BY conf")
def confidence_report(spark, d):
    from pyspark.sql import Window

    c = with_files(spark, d).groupBy("conf").agg(F.count("*").alias("n"))
    return c.select("conf", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4).alias("percent"))  # one row per confidence


@query("f01_admitted", "SELECT count(*) FILTER (id IS NOT NULL) AS admitted, count(*) FILTER (id IS NULL) AS rejected FROM nodes")
def admitted(spark, d):
    return read(spark, d, "nodes").agg(F.count("id").alias("admitted"), F.count_if(F.col("id").isNull()).alias("rejected"))


@query("j09_endpoint_communities", SIDES + "SELECT edge_id, coalesce(ca, -1) AS ca, coalesce(cb, -1) AS cb FROM w")
def endpoint_communities(spark, d):
    return with_files(spark, d).select("edge_id", F.coalesce("ca", F.lit(-1)).alias("ca"), F.coalesce("cb", F.lit(-1)).alias("cb"))


@query("u09_same_topology", GRAPH + "SELECT (SELECT count(*) FROM (SELECT source, target, relation FROM e EXCEPT SELECT source, target, relation FROM (SELECT DISTINCT source, target, relation FROM e))) = 0 AS same")
def same_topology(spark, d):
    n = nodes(spark, d)
    e = g.linked_edges(read(spark, d, "edges").select("edge_id", "source", "target", "relation", "confidence"), n)
    return g.same_topology(n, e, *export.read_node_link(export.node_link(n, e)))




RULES = ["*.rst", "tools/", "!tools/keep.py", "/nothing", "**/auth/**", "*.go", "!**/load_*.go"]


@query("s05_ignored", "SELECT DISTINCT source_file FROM sources WHERE regexp_matches(source_file, '\\.rst$') OR regexp_matches(source_file, '(^|/)tools/.') OR regexp_matches(source_file, '^nothing(/|$)') OR regexp_matches(source_file, '(^|/)auth/.') OR (regexp_matches(source_file, '\\.go$') AND NOT regexp_matches(source_file, '(^|/)load_[^/]*\\.go$'))")
def ignored_files(spark, d):
    from tessera.operators.resolution import ignored

    return read(spark, d, "sources").where(ignored(F.col("source_file"), RULES)).select("source_file").distinct()


@query("t05_budget", GRAPH + ", x AS (SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 500), y AS (SELECT id, sum(length(id) + 1) OVER (ORDER BY degree DESC, id) AS upto FROM x) SELECT id, upto::BIGINT AS upto FROM y WHERE upto <= 3000")
def budget(spark, d):
    from tessera.operators.resolution import within_budget

    top = g.degree(edges(spark, d)).orderBy(F.desc("degree"), "id").limit(500)
    return within_budget(top.withColumn("line", F.col("id")), [F.desc("degree"), F.col("id")], 3000).select("id", "upto")


@query("q11_resolve_seed")
def resolve_seed(spark, d):
    n = nodes(spark, d).where("label is not null")
    by = n.groupBy(r.bare_label(F.col("label")).alias("name")).agg(F.min("id").alias("id"), F.count("*").alias("c"))
    return by.select("name", F.when(F.col("c") == 1, F.col("id")).alias("id"))


@query("q10_import_chains")
def import_chains(spark, d):
    from tessera.operators.resolution import follow

    links = edges(spark, d).where("relation = 'imports' and source <> target").select(F.col("source").alias("name"), F.col("target").alias("to"))
    return follow(links)
