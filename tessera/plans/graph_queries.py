"""Queries of the graph operators over the tables nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.ids import label_key
from tessera.operators import graph as g
from tessera.operators import rules as r
from tessera.operators import search as s
from tessera.plans.registry import GRAPH, SCORED, query
from tessera.session import cut, read


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.latest_nodes(read(spark, d, "nodes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return g.linked_edges(read(spark, d, "edges"), nodes(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    conf = r.confidence(F.col("confidence"))
    return edges(spark, d).withColumn("conf", conf).withColumn("score", r.confidence_score(F.col("confidence_score"), F.col("conf")))


REAL = """NOT ((coalesce(label,'') = split_part(coalesce(source_file,''), '/', -1) AND coalesce(label,'') <> '') OR regexp_matches(coalesce(label,''), '^\\.[^()]*\\(\\)$') OR (coalesce(label,'') LIKE '%()' AND degree <= 1))
 AND NOT (coalesce(source_file,'') = '' OR NOT contains(split_part(coalesce(source_file,''), '/', -1), '.'))"""


@query("t01_most_connected", GRAPH + f"SELECT id, label, degree FROM n JOIN deg USING (id) WHERE {REAL} AND coalesce(label,'') NOT IN ({','.join(repr(x) for x in r.NOISE_LABELS)}) ORDER BY degree DESC, id LIMIT 10")
def most_connected(spark, d):
    found = nodes(spark, d).join(g.degree(edges(spark, d)), "id")
    label = F.coalesce(F.col("label"), F.lit(""))
    real = found.where(~r.is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~r.is_concept_node(F.col("source_file")) & ~label.isin(r.NOISE_LABELS))
    return real.orderBy(F.desc("degree"), "id").limit(10).select("id", "label", "degree")


@query("g01_degree", GRAPH + "SELECT * FROM deg")
def degree(spark, d):
    return g.degree(edges(spark, d))


@query("g02_latest_nodes", GRAPH + "SELECT id, label, file_type, coalesce(community, -1) AS community FROM n")
def latest_nodes(spark, d):
    return nodes(spark, d).select("id", "label", "file_type", F.coalesce("community", F.lit(-1)).alias("community"))


@query("g03_first_edges", "SELECT source, target, relation, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY ingested_at, edge_id) AS rk FROM edges WHERE source IS NOT NULL AND target IS NOT NULL) WHERE rk = 1")
def first_edges(spark, d):
    e = read(spark, d, "edges").where("source is not null and target is not null")
    return g.first_by(e, ["source", "target", "relation"], [F.col("ingested_at"), F.col("edge_id")]).select("source", "target", "relation", "edge_id")


@query("g04_collapse_directed", GRAPH + "SELECT source, target, relation, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY coalesce(relation,'') DESC, edge_id DESC) AS rk FROM e) WHERE rk = 1")
def collapse_directed(spark, d):
    return g.collapse_directed(edges(spark, d)).select("source", "target", "relation", "edge_id")


@query("g04_collapse_undirected", GRAPH + """, k AS (SELECT DISTINCT source, target, coalesce(relation,'') AS relation, least(source, target) AS a, greatest(source, target) AS b FROM e),
q AS (SELECT a, b, max(relation) FILTER (source = a) AS f, max(relation) FILTER (source <> a) AS r, min(relation) FILTER (source <> a) AS rl FROM k GROUP BY a, b)
SELECT CASE WHEN r IS NULL OR (f IS NOT NULL AND r = f AND rl = f) THEN a ELSE b END AS source, CASE WHEN r IS NULL OR (f IS NOT NULL AND r = f AND rl = f) THEN b ELSE a END AS target, CASE WHEN r IS NULL OR (f IS NOT NULL AND r = f AND rl = f) THEN f ELSE r END AS relation FROM q""")
def collapse_undirected(spark, d):
    return g.collapse_undirected(edges(spark, d))


@query("j01_linked_edges", GRAPH + "SELECT edge_id, source, target FROM e")
def linked(spark, d):
    return edges(spark, d).select("edge_id", "source", "target")


@query("k02_dangling_edges", GRAPH + "SELECT DISTINCT edge_id, source, target FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM e)")
def dangling(spark, d):
    return g.dangling(read(spark, d, "edges"), nodes(spark, d))


@query("p04_slashes", "SELECT seq, regexp_replace(replace(source_file, '\\', '/'), '^(\\./|/)+', '') AS path FROM nodes")
def slashes(spark, d):
    return read(spark, d, "nodes").select("seq", r.slashes(F.col("source_file")).alias("path"))


@query("p06_file_types", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lower(trim(file_type)) IN ('code','document','paper','image','rationale','concept') THEN lower(trim(file_type)) WHEN lower(trim(file_type)) IN ('markdown','text') THEN 'document' WHEN lower(trim(file_type)) IN ('tool','library') THEN 'code' ELSE 'concept' END AS kind FROM nodes) GROUP BY kind")
def file_types(spark, d):
    return read(spark, d, "nodes").groupBy(r.file_type(F.col("file_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("p07_scores", SCORED + "SELECT edge_id, conf, score FROM s")
def scores(spark, d):
    return scored(spark, d).select("edge_id", "conf", "score")


@query("p08_edge_files", GRAPH + "SELECT e.edge_id, coalesce(nullif(e.source_file,''), nullif(a.source_file,''), nullif(b.source_file,''), '') AS source_file FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target")
def edge_files(spark, d):
    n = nodes(spark, d)
    a, b = n.select(F.col("id").alias("source"), F.col("source_file").alias("fa")), n.select(F.col("id").alias("target"), F.col("source_file").alias("fb"))
    joined = edges(spark, d).join(a, "source").join(b, "target")
    return joined.select("edge_id", F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("source_file", "fa", "fb")), F.lit("")).alias("source_file"))


@query("p09_clean_labels", "SELECT seq, left(regexp_replace(label, '[\\x00-\\x1f\\x7f]', '', 'g'), 256) AS label FROM nodes")
def clean_labels(spark, d):
    return read(spark, d, "nodes").select("seq", r.clean_label(F.col("label")).alias("label"))


_SUFFIX = "lower(regexp_extract(coalesce({0},''), '\\.([A-Za-z0-9]+)$', 1))"


def _family_sql(x: str) -> str:
    s = _SUFFIX.format(x)
    return "CASE " + " ".join(f"WHEN {s} IN ({','.join(repr(v) for v in vs.split())}) THEN '{k}'" for k, vs in r.FAMILIES.items()) + " END"


def _category_sql(x: str) -> str:
    s = _SUFFIX.format(x)
    return f"CASE WHEN {s} IN ({','.join(repr(v) for v in r.CODE.split())}) THEN 'code' WHEN {s} = 'pdf' THEN 'paper' WHEN {s} IN ('png','jpg','jpeg','gif','webp','svg') THEN 'image' ELSE 'doc' END"


@query("p11_categories", f"SELECT {_category_sql('source_file')} AS category, {_family_sql('source_file')} AS family, split_part(source_file, '/', 1) AS top, count(*) AS n FROM nodes GROUP BY 1, 2, 3")
def categories(spark, d):
    f = F.col("source_file")
    return read(spark, d, "nodes").groupBy(r.category(f).alias("category"), r.family(f).alias("family"), r.top_folder(f).alias("top")).agg(F.count("*").alias("n"))


@query("p12_test_paths", "SELECT scan_id FROM sources WHERE regexp_matches(source_file, '(?i)(^|/)(tests?|specs?|__tests__)(/|$)') OR regexp_matches(split_part(source_file,'/',-1), '(?i)^test_|_test\\..+$|\\.test\\..+$|\\.spec\\..+$|_spec\\..+$|\\.tests\\.ps1$') OR regexp_matches(split_part(source_file,'/',-1), 'Tests?\\.java$|Tests\\.cs$')")
def test_paths(spark, d):
    return read(spark, d, "sources").where(r.is_test_path(F.col("source_file"))).select("scan_id")


@query("p13_entropy")
def label_entropy(spark, d):
    labels = read(spark, d, "nodes").select("label").unionByName(read(spark, d, "shared_nodes").select("label"))
    keys = labels.distinct().select(label_key(F.coalesce("label", F.lit(""))).alias("key")).distinct()
    return keys.select("key", (r.entropy(F.col("key")) + 0.0).alias("entropy"))


@query("p14_shingles", "SELECT label, len(list_distinct(CASE WHEN length(label) < 3 THEN [label] ELSE list_transform(range(1, length(label) - 1), lambda i: substr(label, i, 3)) END))::BIGINT AS shingles FROM (SELECT DISTINCT label FROM nodes WHERE label <> '')")
def shingle_counts(spark, d):
    labels = read(spark, d, "nodes").where("label <> ''").select("label").distinct()
    return labels.select("label", F.size(r.shingles(F.col("label"))).cast("long").alias("shingles"))


@query("p15_content_hashes", "SELECT scan_id, md5(content) AS md5, sha256(content) AS sha FROM sources")
def content_hashes(spark, d):
    return read(spark, d, "sources").select("scan_id", F.md5(F.encode("content", "UTF-8")).alias("md5"), F.sha2(F.encode("content", "UTF-8"), 256).alias("sha"))


@query("p16_community_signatures", GRAPH + "SELECT community, sum(('0x' || substr(md5(id), 1, 15))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr(md5(id), 16, 15))::BIGINT)::VARCHAR AS signature, count(*) AS size FROM n WHERE community IS NOT NULL GROUP BY community")
def signatures(spark, d):
    """A fingerprint of each community's set of members: sums of two halves of the members' hashes, which
    unlike a hash of the sorted members are partial aggregates."""
    half = lambda at: F.sum(F.conv(F.substring(F.md5(F.encode("id", "UTF-8")), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return nodes(spark, d).where("community is not null").groupBy("community").agg(F.concat_ws("-", half(1), half(16)).alias("signature"), F.count("*").alias("size"))


@query("p17_tokens", "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents WHERE text IS NOT NULL")
def tokens(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", r.estimated_tokens(F.col("text")).alias("tokens"))


@query("p19_bare_names")
def bare_names(spark, d):
    return read(spark, d, "nodes").select("seq", r.bare_label(F.col("label")).alias("bare"))


@query("s02_file_classes", "SELECT lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) AS suffix, CASE WHEN lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) IN ('py','js','ts','go','java','rs','c') THEN 'code' WHEN lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) IN ('md','mdx','rst','txt') THEN 'document' END AS kind, count(*) AS n FROM sources GROUP BY 1, 2")
def file_classes(spark, d):
    sx = r.suffix(F.col("source_file"))
    kind = F.when(sx.isin("py", "js", "ts", "go", "java", "rs", "c"), "code").when(sx.isin("md", "mdx", "rst", "txt"), "document")
    return read(spark, d, "sources").groupBy(sx.alias("suffix"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("s06_words", "SELECT scan_id, len(list_filter(regexp_split_to_array(content, '[\\s\\p{Z}\\x0b\\x85]+'), lambda x: x <> '')) AS words FROM sources WHERE content IS NOT NULL")
def word_counts(spark, d):
    return read(spark, d, "sources").where("content is not null").select("scan_id", r.words(F.col("content")).cast("long").alias("words"))


@query("f03_violations", GRAPH + """SELECT 'dangling' AS fault, count(*) AS n FROM (SELECT DISTINCT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM e) AND source IS NOT NULL AND target IS NOT NULL)
UNION ALL SELECT 'no_endpoint', count(DISTINCT edge_id) FROM edges WHERE source IS NULL OR target IS NULL UNION ALL SELECT 'no_label', count(*) FROM nodes WHERE label IS NULL
UNION ALL SELECT 'file_type', count(*) FROM nodes WHERE file_type IS NULL OR file_type NOT IN ('code','document','paper','image','rationale','concept') UNION ALL SELECT 'confidence', count(*) FROM edges WHERE confidence IS NULL OR confidence NOT IN ('EXTRACTED','INFERRED','AMBIGUOUS')""")
def violations(spark, d):
    e, n = read(spark, d, "edges"), read(spark, d, "nodes")
    half = F.col("source").isNull() | F.col("target").isNull()
    missing = g.dangling(e, nodes(spark, d)).where(~half).select("edge_id").distinct()
    one = lambda df, fault, what: df.agg(what.alias("n")).select(F.lit(fault).alias("fault"), "n")
    parts = [
        one(missing, "dangling", F.count("*")), one(e, "no_endpoint", F.countDistinct(F.when(half, F.col("edge_id")))), one(n, "no_label", F.count_if(F.col("label").isNull())),
        one(n, "file_type", F.count_if(~F.coalesce(F.col("file_type").isin(*r.FILE_TYPES), F.lit(False)))), one(e, "confidence", F.count_if(~F.coalesce(F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), F.lit(False)))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("f04_bad_ids", "SELECT seq FROM nodes WHERE length(id) > 256 OR NOT regexp_matches(id, '^[A-Za-z0-9._:-]+$') OR contains(id, '..')")
def bad_ids(spark, d):
    i = F.col("id")
    return read(spark, d, "nodes").where((F.length(i) > 256) | ~i.rlike(r"^[A-Za-z0-9._:-]+$") | i.contains("..")).select("seq")


@query("f06_real_nodes", GRAPH + f"SELECT id FROM (SELECT n.id, label, source_file, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg USING (id)) WHERE {REAL}")
def real_nodes(spark, d):
    n = nodes(spark, d).join(g.degree(edges(spark, d)), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return n.where(~r.is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~r.is_concept_node(F.col("source_file"))).select("id")


def with_files(spark, d) -> DataFrame:
    n = nodes(spark, d)
    side = lambda end, x: n.select(F.col("id").alias(end), F.col("source_file").alias(x), F.col("community").alias("c" + x), F.col("label").alias("l" + x))
    return scored(spark, d).join(side("source", "a"), "source").join(side("target", "b"), "target")


SIDES = SCORED + ", w AS (SELECT s.*, x.source_file AS a, y.source_file AS b, x.community AS ca, y.community AS cb FROM s JOIN n x ON x.id = s.source JOIN n y ON y.id = s.target)\n"


@query("f10_language_guard", SIDES + f"SELECT edge_id FROM w WHERE relation = 'calls' AND conf = 'INFERRED' AND {_SUFFIX.format('a')} <> '' AND {_SUFFIX.format('b')} <> '' AND {_family_sql('a')} IS DISTINCT FROM {_family_sql('b')} OR relation IN ('imports','imports_from','references') AND {_family_sql('a')} <> {_family_sql('b')}")
def language_guard(spark, d):
    a, b = F.col("a"), F.col("b")
    calls = (F.col("relation") == "calls") & (F.col("conf") == "INFERRED") & (r.suffix(a) != "") & (r.suffix(b) != "") & ~r.family(a).eqNullSafe(r.family(b))
    other = F.col("relation").isin("imports", "imports_from", "references") & r.cross_language(a, b)
    return with_files(spark, d).where(calls | other).select("edge_id")


@query("f13_context_filter", GRAPH + "SELECT edge_id FROM e WHERE context IN ('call','import')")
def context_filter(spark, d):
    return edges(spark, d).where(F.col("context").isin("call", "import")).select("edge_id")


@query("f15_preferred_edges", SCORED + "SELECT edge_id FROM s WHERE (conf = 'EXTRACTED' OR (conf = 'INFERRED' AND score >= 0.85)) AND relation IN ('calls','uses','method','imports','imports_from')")
def preferred(spark, d):
    c = F.col("conf")
    return scored(spark, d).where(((c == "EXTRACTED") | ((c == "INFERRED") & (F.col("score") >= 0.85))) & F.col("relation").isin("calls", "uses", "method", "imports", "imports_from")).select("edge_id")


@query("g11_cohesion", GRAPH + ", i AS (SELECT x.community, count(*) AS inside FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE x.community = y.community GROUP BY 1) SELECT community, n, CASE WHEN n <= 1 THEN 1.0 ELSE round(coalesce(inside, 0) / (n * (n - 1) / 2.0), 6) END AS cohesion FROM (SELECT community, count(*) AS n FROM n WHERE community IS NOT NULL GROUP BY community) LEFT JOIN i USING (community)")
def cohesion(spark, d):
    n = nodes(spark, d).where("community is not null").select("id", "community")
    p = g.pairs(edges(spark, d)).join(n.toDF("a", "ca"), "a").join(n.toDF("b", "cb"), "b").where("ca = cb")
    inside = p.groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inside"))
    size = n.groupBy("community").agg(F.count("*").alias("n"))
    value = F.when(F.col("n") <= 1, 1.0).otherwise(F.round(F.coalesce("inside", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2.0), 6))
    return size.join(inside, "community", "left").select("community", "n", value.alias("cohesion"))


@query("g12_community_hubs", GRAPH + "SELECT community, regexp_replace(coalesce(label, id), '\\(\\)$', '') AS name FROM (SELECT n.*, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, n.id) AS rk FROM n LEFT JOIN deg USING (id) WHERE community IS NOT NULL) WHERE rk = 1")
def community_hubs(spark, d):
    n = nodes(spark, d).where("community is not null").join(g.degree(edges(spark, d)), "id", "left")
    best = n.groupBy("community").agg(F.min_by(F.coalesce("label", "id"), F.struct(-F.coalesce("degree", F.lit(0)), F.col("id"))).alias("name"))
    return best.select("community", F.regexp_replace("name", r"\(\)$", "").alias("name"))


@query("g13_stats", SCORED + "SELECT conf, count(*) AS n, round(avg(score), 6) AS mean FROM s GROUP BY conf")
def stats(spark, d):
    return scored(spark, d).groupBy("conf").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("g15_thin_communities", GRAPH + "SELECT community, count(*) AS n FROM n WHERE community IS NOT NULL GROUP BY community HAVING count(*) < 40")
def thin(spark, d):
    return nodes(spark, d).where("community is not null").groupBy("community").agg(F.count("*").alias("n")).where("n < 40")


@query("g16_idf")
def idf(spark, d):
    n = read(spark, d, "nodes").select("label").distinct().withColumn("source_file", F.lit(""))
    return s.idf(n, ["graph", "token", "cache", "buffer"])


@query("g17_file_graph", SIDES + "SELECT DISTINCT a, b FROM w WHERE relation IN ('imports','imports_from','re_exports') AND a IS NOT NULL AND b IS NOT NULL")
def file_graph(spark, d):
    return with_files(spark, d).where("relation in ('imports','imports_from','re_exports') and a is not null and b is not null").select("a", "b").distinct()


@query("g18_cross_links", SIDES + "SELECT ca, cb, count(*) AS links FROM w WHERE ca <> cb GROUP BY ca, cb")
def cross_links(spark, d):
    return with_files(spark, d).where("ca <> cb").groupBy("ca", "cb").agg(F.count("*").alias("links"))


@query("k09_meta_graph", SIDES + "SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, count(*) AS n FROM w WHERE ca <> cb GROUP BY 1, 2")
def meta_graph(spark, d):
    return with_files(spark, d).where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"))


@query("g19_edge_classes", SIDES + "SELECT CASE WHEN ca IS NULL OR cb IS NULL THEN 'orphan' WHEN ca = cb THEN 'intra' ELSE 'inter' END AS kind, relation, count(*) AS n FROM w GROUP BY 1, 2")
def edge_classes(spark, d):
    kind = F.when(F.col("ca").isNull() | F.col("cb").isNull(), "orphan").when(F.col("ca") == F.col("cb"), "intra").otherwise("inter")
    return with_files(spark, d).groupBy(kind.alias("kind"), "relation").agg(F.count("*").alias("n"))


_SCORE = "score + CASE WHEN conf = 'EXTRACTED' THEN 2.0 ELSE 0 END + CASE WHEN relation IN ('calls','uses','method') THEN 1.0 WHEN relation IN ('imports','imports_from') THEN 0.6 WHEN relation = 'contains' THEN -0.2 WHEN relation = 'rationale_for' THEN -0.6 ELSE 0 END"


@query("g20_weighted_degrees", SCORED + f"SELECT id, round(sum(v), 4) AS weight FROM (SELECT source AS id, {_SCORE} AS v FROM s UNION ALL SELECT target, {_SCORE} FROM s) GROUP BY id")
def weighted_degrees(spark, d):
    e = scored(spark, d).select(F.explode(F.array("source", "target")).alias("id"), r.edge_score(F.col("relation"), F.col("conf"), F.col("score")).alias("v"))
    return e.groupBy("id").agg(F.round(F.sum("v"), 4).alias("weight"))


@query("g21_diagnosis", GRAPH + "SELECT count(*) AS edges, count(*) FILTER (source = target) AS loops, count(*) - count(DISTINCT source || chr(1) || target) AS collapsed, count(*) - count(DISTINCT source || chr(1) || target || chr(1) || coalesce(relation,'')) AS repeated FROM e")
def diagnosis(spark, d):
    e = edges(spark, d)
    by = e.groupBy("source", "target", F.coalesce("relation", F.lit("")).alias("rel")).agg(F.count("*").alias("n"))
    pair = by.groupBy("source", "target").agg(F.sum("n").alias("n"), F.count("*").alias("rels"))
    return pair.agg(F.sum("n").alias("edges"), F.sum(F.when(F.col("source") == F.col("target"), F.col("n")).otherwise(0)).alias("loops"), F.sum(F.col("n") - 1).alias("collapsed"), F.sum(F.col("n") - F.col("rels")).alias("repeated"))


@query("g31_variant_pairs", GRAPH + "SELECT count(*) AS pairs FROM (SELECT source, target FROM e GROUP BY source, target HAVING count(DISTINCT relation) > 1)")
def variant_pairs(spark, d):
    return edges(spark, d).groupBy("source", "target").agg(F.countDistinct("relation").alias("k")).where("k > 1").agg(F.count("*").alias("pairs"))


@query("t03_community_order", GRAPH + "SELECT community, row_number() OVER (ORDER BY n DESC, first) - 1 AS place FROM (SELECT community, count(*) AS n, min(id) AS first FROM n WHERE community IS NOT NULL GROUP BY community)")
def community_order(spark, d):
    c = nodes(spark, d).where("community is not null").groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return c.select("community", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("place"))  # one row per community


@query("w03_top_concepts", GRAPH + "SELECT community, id, rank FROM (SELECT community, n.id, row_number() OVER (PARTITION BY community ORDER BY degree DESC, n.id) AS rank FROM n JOIN deg USING (id) WHERE community IS NOT NULL) WHERE rank <= 25")
def top_concepts(spark, d):
    n = nodes(spark, d).where("community is not null").join(g.degree(edges(spark, d)), "id")
    return g.top_k(n, ["community"], [F.desc("degree"), F.col("id")], 25).select("community", "id", F.col("rank").cast("long").alias("rank"))


@query("t10_sample_labels", GRAPH + "SELECT community, string_agg(label, '|' ORDER BY rk) AS labels FROM (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS rk FROM (SELECT community, left(label, 60) AS label, max(degree) AS degree, min(n.id) AS id FROM n JOIN deg USING (id) WHERE community IS NOT NULL AND label IS NOT NULL GROUP BY community, left(label, 60))) WHERE rk <= 12 GROUP BY community")
def sample_labels(spark, d):
    n = nodes(spark, d).where("community is not null and label is not null").join(g.degree(edges(spark, d)), "id")
    one = n.groupBy("community", F.substring("label", 1, 60).alias("label")).agg(F.max("degree").alias("degree"), F.min("id").alias("id"))
    few = g.top_k(one, ["community"], [F.desc("degree"), F.col("id")], 12)
    listed = F.array_sort(F.collect_list(F.struct("rank", "label")))
    return few.groupBy("community").agg(F.array_join(F.transform(listed, lambda x: x["label"]), "|").alias("labels"))


@query("q16_import_cycles", SIDES + """, f AS (SELECT DISTINCT a, b FROM w WHERE relation IN ('imports','imports_from','re_exports') AND a IS NOT NULL AND b IS NOT NULL)
SELECT a AS cycle, 1 AS length FROM f WHERE a = b UNION ALL SELECT x.a || ' > ' || x.b, 2 FROM f x JOIN f y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b
UNION ALL SELECT x.a || ' > ' || x.b || ' > ' || y.b, 3 FROM f x JOIN f y ON y.a = x.b JOIN f z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b
UNION ALL SELECT x.a || ' > ' || x.b || ' > ' || y.b || ' > ' || z.b, 4 FROM f x JOIN f y ON y.a = x.b JOIN f z ON z.a = y.b JOIN f u ON u.a = z.b AND u.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.a < z.b AND x.b <> y.b AND x.b <> z.b AND y.b <> z.b
UNION ALL SELECT x.a || ' > ' || x.b || ' > ' || y.b || ' > ' || z.b || ' > ' || u.b, 5 FROM f x JOIN f y ON y.a = x.b JOIN f z ON z.a = y.b JOIN f u ON u.a = z.b JOIN f v ON v.a = u.b AND v.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.a < z.b AND x.a < u.b AND x.b <> y.b AND x.b <> z.b AND x.b <> u.b AND y.b <> z.b AND y.b <> u.b AND z.b <> u.b""")
def import_cycles(spark, d):
    f = file_graph(spark, d)
    one = f.where("a = b").select(F.col("a").alias("cycle"), F.lit(1).alias("length"))
    steps = f.where("a <> b").toDF("x", "y")
    # every cycle starts at its smallest file v1; walks from v1 meet walks back to it, so that none is longer than three steps
    ahead = [steps.where("x < y").toDF("v1", "v2")]
    for k in (2, 3):
        new = F.col("y")
        ahead.append(ahead[-1].join(steps, F.col(f"v{k}") == F.col("x")).where((new > F.col("v1")) & ~new.isin(*(F.col(f"v{i}") for i in range(2, k + 1)))).withColumnRenamed("y", f"v{k + 1}").drop("x"))
    back = steps.where("y < x").select(F.col("y").alias("v1"), F.col("x").alias("last"))
    back2 = back.join(steps, F.col("last") == F.col("y")).where("x > v1").select("v1", F.col("x").alias("end"), "last")
    out = one
    for k, walk in enumerate(ahead[:2], 2):
        out = out.unionByName(_closed(walk.join(back.withColumnRenamed("last", f"v{k}"), ["v1", f"v{k}"]), k))
    for k, walk in enumerate(ahead[1:], 3):
        met = walk.join(back2.withColumnRenamed("end", f"v{k}"), ["v1", f"v{k}"]).where(~F.col("last").isin(*(F.col(f"v{i}") for i in range(2, k))))
        out = out.unionByName(_closed(met.withColumnRenamed("last", f"v{k + 1}"), k + 1))
    return out


def _closed(cycles: DataFrame, length: int) -> DataFrame:
    return cycles.select(F.concat_ws(" > ", *(f"v{i}" for i in range(1, length + 1))).alias("cycle"), F.lit(length).alias("length"))


_MUTED = f"(conf = 'INFERRED' AND relation IN ('calls','uses') AND (coalesce({_family_sql('a')} <> {_family_sql('b')}, FALSE) OR ({_category_sql('a')} = 'code' AND {_category_sql('b')} = 'doc') OR ({_category_sql('a')} = 'doc' AND {_category_sql('b')} = 'code')))"
_SURPRISE = SIDES + f""", x AS (SELECT w.*, coalesce(da.degree, 0) AS da, coalesce(db.degree, 0) AS db, {_MUTED} AS muted FROM w LEFT JOIN deg da ON da.id = w.source LEFT JOIN deg db ON db.id = w.target WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
y AS (SELECT *, CASE WHEN muted THEN 0 WHEN conf = 'AMBIGUOUS' THEN 3 WHEN conf = 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN NOT muted AND {_category_sql('a')} <> {_category_sql('b')} THEN 2 ELSE 0 END + CASE WHEN NOT muted AND split_part(a,'/',1) <> split_part(b,'/',1) THEN 2 ELSE 0 END + CASE WHEN NOT muted AND coalesce(ca <> cb, FALSE) THEN 1 ELSE 0 END AS base FROM x),
z AS (SELECT *, (CASE WHEN relation = 'semantically_similar_to' THEN floor(base * 1.5) ELSE base END + CASE WHEN least(da, db) <= 2 AND greatest(da, db) >= 5 THEN 1 ELSE 0 END)::INT AS surprise FROM y)
"""


def surprises(spark, d) -> DataFrame:
    deg = g.degree(edges(spark, d))
    e = with_files(spark, d).where("a is not null and b is not null and a <> b")
    e = e.join(deg.toDF("source", "da"), "source", "left").join(deg.toDF("target", "db"), "target", "left").fillna(0, ["da", "db"])
    return e.withColumn("surprise", r.surprise({k: F.col(k) for k in ("conf", "relation", "a", "b", "ca", "cb", "da", "db")}))


@query("q18_surprise_scores", _SURPRISE + "SELECT edge_id, surprise FROM z")
def surprise_scores(spark, d):
    return surprises(spark, d).select("edge_id", "surprise")


@query("t04_top_surprises", _SURPRISE + "SELECT edge_id, source, target, surprise FROM z WHERE relation NOT IN ('imports','imports_from','contains','method') ORDER BY surprise DESC, edge_id LIMIT 20")
def top_surprises(spark, d):
    e = surprises(spark, d).where(~F.col("relation").isin("imports", "imports_from", "contains", "method"))
    return e.orderBy(F.desc("surprise"), "edge_id").limit(20).select("edge_id", "source", "target", "surprise")


@query("w07_community_surprises", SIDES + "SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, arg_min(edge_id, (CASE conf WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END) * 10000000000 + edge_id) AS edge_id FROM w WHERE ca <> cb GROUP BY 1, 2")
def community_surprises(spark, d):
    order = F.struct(F.when(F.col("conf") == "AMBIGUOUS", 0).when(F.col("conf") == "INFERRED", 1).otherwise(2), F.col("edge_id"))
    return with_files(spark, d).where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.min_by("edge_id", order).alias("edge_id"))


@query("u02_graph_diff", "WITH o AS (SELECT DISTINCT id FROM nodes WHERE captured_at < TIMESTAMP '2025-06-01' OR captured_at IS NULL), w AS (SELECT DISTINCT id FROM nodes WHERE captured_at >= TIMESTAMP '2025-03-01') SELECT 'added' AS change, id FROM (SELECT id FROM w EXCEPT SELECT id FROM o) UNION ALL SELECT 'removed', id FROM (SELECT id FROM o EXCEPT SELECT id FROM w)")
def graph_diff(spark, d):
    n = read(spark, d, "nodes")
    return g.diff(n.where("captured_at < timestamp_ntz'2025-06-01' or captured_at is null"), n.where("captured_at >= timestamp_ntz'2025-03-01'"), ["id"])


@query("u03_repo_prefix", GRAPH + "SELECT repo || '::' || id AS id, id AS local_id, repo FROM n WHERE repo IS NOT NULL")
def repo_prefix(spark, d):
    return nodes(spark, d).where("repo is not null").select(F.concat_ws("::", "repo", "id").alias("id"), F.col("id").alias("local_id"), "repo")


@query("u06_overlap", "WITH o AS (SELECT id, arg_max(community, (coalesce(captured_at, TIMESTAMP '0001-01-01'), seq)) AS c FROM nodes WHERE community IS NOT NULL AND id IS NOT NULL AND (captured_at < TIMESTAMP '2025-06-01' OR captured_at IS NULL) GROUP BY id), w AS (SELECT id, arg_max(community, (captured_at, seq)) AS c FROM nodes WHERE community IS NOT NULL AND id IS NOT NULL AND captured_at >= TIMESTAMP '2025-03-01' GROUP BY id) SELECT o.c AS old, w.c AS new, count(*) AS n FROM o JOIN w USING (id) GROUP BY 1, 2")
def overlap(spark, d):
    """Members that communities of an earlier and of a later state share."""
    n = read(spark, d, "nodes").where("community is not null")
    state = lambda when, name: g.latest_nodes(n.where(when)).select("id", F.col("community").alias(name))
    both = state("captured_at < timestamp_ntz'2025-06-01' or captured_at is null", "old").join(state("captured_at >= timestamp_ntz'2025-03-01'", "new"), "id")
    return both.groupBy("old", "new").agg(F.count("*").alias("n"))


@query("k11_path_totals", "WITH f AS (SELECT DISTINCT source_file FROM sources), x AS (SELECT array_to_string(list_slice(string_split(source_file, '/'), 1, i), '/') AS folder FROM f, LATERAL (SELECT unnest(range(1, len(string_split(source_file, '/')))) AS i)) SELECT folder, count(*) AS files FROM x GROUP BY folder")
def path_totals(spark, d):
    parts = F.split("source_file", "/")
    f = read(spark, d, "sources").select("source_file").distinct().where(F.size(parts) > 1)
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return f.select(F.explode(prefix).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


START = "(SELECT id FROM deg ORDER BY degree DESC, id LIMIT 3)"


def _start(links: DataFrame) -> DataFrame:
    return g.degree(links).orderBy(F.desc("degree"), "id").limit(3).select("id")


def _levels(step: str, depth: int, extra: str = "") -> str:
    out = f", v0 AS (SELECT id, 0 AS hops FROM {START})"
    for k in range(1, depth + 1):
        out += f", v{k} AS (SELECT * FROM v{k-1} UNION ALL SELECT DISTINCT x.id, {k} FROM ({step.format(frontier=f'(SELECT id FROM v{k-1} WHERE hops = {k-1}{extra if k > 1 else ''})')}) x WHERE x.id NOT IN (SELECT id FROM v{k-1}))"
    return out


@query("q01_breadth_first", GRAPH + ", h AS (SELECT greatest(50, min(degree)) AS t FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS c FROM deg) WHERE i >= floor(c * 0.99)), hubs AS (SELECT id FROM deg, h WHERE degree >= t)" + _levels("SELECT target AS id FROM e WHERE source IN {frontier}", 3, " AND id NOT IN (SELECT id FROM hubs)") + " SELECT * FROM v3")
def bfs(spark, d):
    links = cut(edges(spark, d).select("source", "target").distinct())  # read by the degrees, the start and each level
    return s.breadth_first(links, _start(links), 3)


@query("q09_distances", GRAPH + _levels("SELECT other AS id FROM links WHERE links.id IN {frontier}", 8) + " SELECT * FROM v8")
def distance(spark, d):
    # ids become numbers, once, so that each of the eight levels shuffles pairs of numbers
    ids = cut(nodes(spark, d).select("id", F.monotonically_increasing_id().alias("n")))
    side = lambda end: ids.select(F.col("id").alias(end), F.col("n").alias("n" + end))
    simple = g.pairs(read(spark, d, "edges")).join(side("a"), "a").join(side("b"), "b")
    links = cut(g.both_ways(simple.select(F.col("na").alias("a"), F.col("nb").alias("b"))))
    degrees = links.groupBy(F.col("id").alias("n")).agg(F.count("*").alias("degree"))
    start = degrees.join(ids, "n").orderBy(F.desc("degree"), "id").limit(3).select(F.col("n").alias("id"))
    return s.distances(links, start, 8).withColumnRenamed("id", "n").join(ids, "n").select("id", "hops")


@query("q10_affected", GRAPH + ", r AS (SELECT DISTINCT source, target, relation FROM e WHERE relation IN ('calls','imports','references','uses'))" + f", s0 AS {START}, a1 AS (SELECT source AS id, 1 AS hops, min(relation) AS via FROM r WHERE target IN (SELECT id FROM s0) AND source NOT IN (SELECT id FROM s0) GROUP BY source), a2 AS (SELECT source AS id, 2 AS hops, min(relation) AS via FROM r WHERE target IN (SELECT id FROM a1) AND source NOT IN (SELECT id FROM s0) AND source NOT IN (SELECT id FROM a1) GROUP BY source) SELECT * FROM a1 UNION ALL SELECT * FROM a2")
def impact(spark, d):
    links = cut(edges(spark, d).select("source", "target", "relation").distinct())
    return s.affected(links, _start(links), ["calls", "imports", "references", "uses"])


@query("q08_community_members", GRAPH + "SELECT id, label FROM n WHERE community = 3")
def members(spark, d):
    return nodes(spark, d).where("community = 3").select("id", "label")


@query("q03_ranked_search")
def search(spark, d):
    return s.ranked(nodes(spark, d), "how does the token cache work with parse graph")


@query("w05_seeds")
def seed_nodes(spark, d):
    return s.seeds(s.ranked(nodes(spark, d), "how does the token cache work with parse graph"))


@query("g08_components")
def components(spark, d):
    return s.components(g.pairs(edges(spark, d)))
