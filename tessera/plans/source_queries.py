"""Queries of file classes, secrets, calls, scopes, context filters and window frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import rules as r
from tessera.operators.search import context_filters
from tessera.plans.build_queries import MEMORY, _memory
from tessera.plans.graph_queries import edges, nodes
from tessera.plans.registry import GRAPH, query
from tessera.session import read
from tessera.sources import classify, extractors

_NAME = "split_part(source_file, '/', -1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '[^.][^/]*?\\.([^./]+)$', 1))"
_CODE = "'py','ts','tsx','js','jsx','go','rs','java','c','h','cpp','rb','cs','php','sql','sh','json'"
_PAPER = " + ".join(f"regexp_matches(left(coalesce(content, ''), 3000), '{p}')::INT" for p in ("(?i)\\barxiv\\b", "(?i)\\bdoi\\s*:", "(?i)\\babstract\\b", "(?i)\\bproceedings\\b", "(?i)\\bjournal\\b", "(?i)\\bpreprint\\b", "\\\\cite\\{", "\\[\\d+\\]", "\\[\\n\\d+\\n\\]", "(?i)eq\\.\\s*\\d+|equation\\s+\\d+", "\\d{4}\\.\\d{4,5}", "(?i)\\bwe propose\\b", "(?i)\\bliterature\\b"))


@query("s02_file_kinds", f"SELECT scan_id, CASE WHEN {_SUFFIX} IN ({_CODE}) THEN 'code' WHEN {_SUFFIX} IN ('md','mdx','rst','txt','html','yaml','yml') THEN CASE WHEN {_PAPER} >= 3 THEN 'paper' ELSE 'document' END END AS kind FROM sources")
def file_kinds(spark, d):
    return read(spark, d, "sources").select("scan_id", classify.file_class(F.col("source_file"), F.col("content")).alias("kind"))


@query("s03_interpreters", "SELECT scan_id, regexp_extract(regexp_extract(coalesce(content, ''), '^#![ \\t]*(?:\\S*/)?(?:env(?:[ \\t]+(?:-\\S+|\\w+=\\S*))*[ \\t]+)?(\\S+)', 1), '([^/]+)$', 1) AS program FROM sources WHERE starts_with(content, '#!')")
def interpreters(spark, d):
    return read(spark, d, "sources").where(F.col("content").startswith("#!")).select("scan_id", classify.interpreter(F.col("content")).alias("program"))


_STEM = f"split_part(regexp_replace({_NAME}, '^\\.+', ''), '.', 1)"
_WORD = "(?i)(^|[^a-zA-Z0-9])((credential|secret|passwd|password|private_key)s?|tokens?)"


@query("s04_sensitive_paths", f"SELECT scan_id FROM sources WHERE regexp_matches(source_file, '(^|/)(\\.ssh|\\.gnupg|\\.aws|\\.gcloud|secrets|\\.secrets|credentials)/') OR regexp_matches({_NAME}, '(?i)^\\.(env|envrc)(\\.|$)|\\.(pem|key|p12|pfx|cert|crt|der|p8)$|(\\.netrc|\\.pgpass|\\.htpasswd)$|(aws_credentials|gcloud_credentials|service.account)') OR regexp_matches({_NAME}, '(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\\.pub)?$') OR ((regexp_matches({_STEM}, '{_WORD}$') OR (regexp_matches({_STEM}, '{_WORD}([^a-zA-Z]|$)') AND len(list_filter(regexp_split_to_array({_STEM}, '[-_\\s]+'), lambda w: w <> '')) <= 2)) AND {_SUFFIX} NOT IN ('py','ts','tsx','js','jsx','go','rs','java','c','h','cpp','rb','cs','php','sql','sh'))")
def sensitive(spark, d):
    return read(spark, d, "sources").where(classify.is_sensitive(F.col("source_file"))).select("scan_id")


@query("f19_in_scope", GRAPH + ", real AS (SELECT DISTINCT source_file FROM sources), sent AS (SELECT DISTINCT source_file FROM sources WHERE repo <> 'ember_crane'), kept AS (SELECT id FROM n WHERE source_file IS NULL OR source_file NOT IN (SELECT source_file FROM real) OR source_file IN (SELECT source_file FROM sent)) SELECT edge_id FROM e WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def in_scope(spark, d):
    """Edges between nodes that are not attributed to real files which were not sent for extraction."""
    real = read(spark, d, "sources").where("source_file is not null").select("source_file", (F.coalesce(F.col("repo") != "ember_crane", F.lit(False))).alias("sent"))
    unsent = real.groupBy("source_file").agg(F.bool_or("sent").alias("sent")).where("not sent").select("source_file")
    outside = nodes(spark, d).join(unsent, "source_file", "left_semi").select("id")
    e = edges(spark, d).select("edge_id", "source", "target")
    return e.join(outside.withColumnRenamed("id", "source"), "source", "left_anti").join(outside.withColumnRenamed("id", "target"), "target", "left_anti").select("edge_id")


@query("j14_resolved_calls")
def resolved_calls(spark, d):
    """(source, target): calls of the present scans, put to the only resolvable node of the called name, if there is
    one and no edge joins the two yet."""
    called = extractors.extract(read(spark, d, "sources")).where("part = 'edge' and kind = 'calls'").select("source", F.col("target").alias("name")).distinct()
    n = nodes(spark, d)
    by_name = n.where(r.is_resolvable(F.col("file_type"), F.col("label"))).groupBy(F.regexp_replace(r.callable_name(F.col("label")), "[^a-z0-9]+", "_").alias("name")).agg(F.min("id").alias("target"), F.count("*").alias("k")).where("k = 1").drop("k")
    found = called.join(by_name, "name").select("source", "target").distinct()
    return found.join(edges(spark, d).select("source", "target"), ["source", "target"], "left_anti")


_HINTS = {"call": "call calls called invoke invokes invoked", "import": "import imports imported module modules", "field": "field fields member members property properties", "parameter_type": "parameter parameters param params argument arguments", "return_type": "return returns returned", "generic_arg": "generic generics template templates"}
_TOKENS = "list_transform(regexp_split_to_array(replace(replace(question, '?', ' '), ',', ' '), '\\s+'), lambda t: lower(strip_accents(t)))"


@query("f12_context_filters", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN list_has_any({_TOKENS}, [{', '.join(repr(w) for w in words.split())}]) THEN '{name}' END" for name, words in _HINTS.items()) + "], lambda x: x IS NOT NULL), ',') AS contexts FROM (SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^question:[ \\t]*\"?([^\"\\n]*)\"?[ \\t]*$', 1)), '') AS question FROM documents WHERE starts_with(text, '---')) WHERE question IS NOT NULL")
def context_of_questions(spark, d):
    asked = _memory(spark, d).where("question is not null")
    return asked.select("doc_id", F.array_join(context_filters(F.col("question")), ",").alias("contexts"))


@query("g29_corpus_tokens", "SELECT repo, (sum(len(list_filter(regexp_split_to_array(content, '[\\s\\p{Z}\\x0b\\x85]+'), lambda x: x <> ''))) * 100 // 75)::BIGINT AS tokens FROM sources WHERE content IS NOT NULL GROUP BY repo")
def corpus_tokens(spark, d):
    words = read(spark, d, "sources").where("content is not null").groupBy("repo").agg(F.sum(r.words(F.col("content"))).alias("w"))
    return words.select("repo", F.floor(F.col("w") * 100 / 75).cast("long").alias("tokens"))


@query("w10_frames", "SELECT event_id, coalesce(lag(event_id) OVER w, -1) AS before, coalesce(lead(event_id) OVER w, -1) AS after, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS place, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.sum("value").over(w.rowsBetween(-2, 0))
    return read(spark, d, "events").select("event_id", F.coalesce(F.lag("event_id").over(w), F.lit(-1)).alias("before"), F.coalesce(F.lead("event_id").over(w), F.lit(-1)).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("place"), F.round(last, 4).alias("last_three"))


@query("g32_sketched_counts", "SELECT relation, TRUE AS near FROM edges WHERE source IS NOT NULL GROUP BY relation")
def sketched_counts(spark, d):
    """Whether a sketch of the distinct sources of each relation is within a tenth of their exact number."""
    e = read(spark, d, "edges").where("source is not null").groupBy("relation").agg(F.approx_count_distinct("source", 0.02).alias("a"), F.countDistinct("source").alias("n"))
    return e.select("relation", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))
