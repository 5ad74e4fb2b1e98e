"""Identity of nodes: aliases, ghosts, twins, survivors, the choice among namesakes, stable communities.

All are equi-joins and algebraic aggregates by key; no group of namesakes is paired with itself.
Nulls and blanks never match. Ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import node_reference
from tessera.operators.rules import basename, bare_name, is_test_path, slashes
from tessera.session import stored


def aliases(nodes: DataFrame) -> DataFrame:
    """(alias, id): normalised ids that are no node's exact id, to the smallest id that has them."""
    known = nodes.select("id").where("id is not null").distinct()
    by_form = known.withColumn("alias", node_reference(F.col("id"))).where("alias is not null").groupBy("alias").agg(F.min("id").alias("id"))
    return by_form.join(known.select(F.col("id").alias("alias")), "alias", "left_anti")


def resolved_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, source, target): endpoints by exact id, else by normalised id; null where neither exists.
    Each distinct spelling is resolved once, so that a hot endpoint costs one row."""
    known = nodes.select("id").where("id is not null").distinct()
    spelled = edges.select(F.explode(F.array("source", "target")).alias("end")).where("end is not null").distinct()
    exact = spelled.join(known.withColumnRenamed("id", "end"), "end", "left_semi").select("end", F.col("end").alias("id"))
    rest = spelled.join(known.withColumnRenamed("id", "end"), "end", "left_anti").withColumn("alias", node_reference(F.col("end")))
    all_forms = known.withColumn("alias", node_reference(F.col("id"))).where("alias is not null").groupBy("alias").agg(F.min("id").alias("id"))
    found = exact.unionByName(rest.join(all_forms, "alias").select("end", "id"))
    once = edges.select("edge_id", "source", "target").distinct()
    return remapped(once, found, keep=False)


def remapped(edges: DataFrame, mapping: DataFrame, keep: bool = True) -> DataFrame:
    """Edges with both endpoints put through (end, id); endpoints without an entry stay, or become null.
    A loop that only the mapping makes is dropped."""
    old = [c for c in edges.columns if c not in ("source", "target")]
    side = lambda end: mapping.select(F.col("end").alias(end), F.col("id").alias("_" + end))
    both = edges.join(side("source"), "source", "left").join(side("target"), "target", "left")
    new = lambda end: F.coalesce("_" + end, end) if keep else F.col("_" + end)
    out = both.select(*old, new("source").alias("_s"), new("target").alias("_t"), (F.col("source") == F.col("target")).alias("_loop"))
    out = out.where(F.coalesce(F.col("_s") != F.col("_t"), F.lit(True)) | F.coalesce("_loop", F.lit(False)))
    return out.select(*old, F.col("_s").alias("source"), F.col("_t").alias("target"))


def ghosts(nodes: DataFrame) -> DataFrame:
    """(end, id): nodes that repeat one found by a grammar (`parsed`), by file name and label.

    Of each (file name, label) the canonical node is the only parsed one or, without one, the first
    located node. Keys with two parsed nodes, and those where located nodes of different files come
    before a parsed one, are ambiguous and left alone; of the others, the last node that is not
    parsed goes into the canonical one."""
    keyed = nodes.select("id", F.btrim("label").alias("label"), basename(F.coalesce("source_file", F.lit(""))).alias("name"), F.coalesce("source_file", F.lit("")).alias("file"), F.col("source_location").isNotNull().alias("located"), "parsed")
    keyed = keyed.where("label <> '' and name <> '' and id is not null")
    first = keyed.where("parsed").groupBy("name", "label").agg(F.count("*").alias("n"), F.max("id").alias("found"))
    both = keyed.where("not parsed").join(first, ["name", "label"], "left")
    early = F.col("located") & (F.col("found").isNull() | (F.col("id") < F.col("found")))
    groups = both.groupBy("name", "label").agg(F.max("n").alias("n"), F.max("found").alias("found"), F.min(F.when(F.col("located"), F.col("id"))).alias("located"), F.min(F.when(early, F.col("file"))).alias("low"), F.max(F.when(early, F.col("file"))).alias("high"))
    clear = groups.where("coalesce(n, 0) < 2 and (low is null or low = high)").withColumn("id", F.coalesce("found", "located"))
    # the last of the key that is not the canonical node itself
    second = both.join(clear.select("name", "label", F.col("id").alias("_c")), ["name", "label"]).where("id <> _c").groupBy("name", "label").agg(F.max("id").alias("end"), F.max("_c").alias("id"))
    return second.select("end", "id")


def doc_twins(nodes: DataFrame) -> DataFrame:
    """(end, id): the bare node of a document to the `_doc` node of the same file."""
    docs = nodes.where("file_type = 'document' and coalesce(source_file, '') <> ''").select("id", "source_file")
    twins = docs.where("id like '%\\\\_doc'").select(F.regexp_replace("id", "_doc$", "").alias("end"), "id", "source_file")
    return twins.join(docs.select(F.col("id").alias("end"), "source_file"), ["end", "source_file"], "left_semi").select("end", "id")


def defines_id(node_id: Column, source_file: Column) -> Column:
    """Whether a node's own file is the one its id encodes: some tail of the file's path, by its
    segments, begins the id's normal form."""
    form = F.btrim(F.regexp_replace(F.lower(node_id), "[^a-z0-9]+", "_"), F.lit("_"))
    stem = F.regexp_replace(F.translate(source_file, "\\", "/"), r"\.[^./]+$", "")
    parts = F.filter(F.transform(F.split(stem, "/"), lambda p: F.btrim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "_"), F.lit("_"))), lambda p: p != "")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts), F.lit(1))), "_"))
    begins = F.exists(tails, lambda t: (t != "") & ((form == t) | form.startswith(F.concat(t, F.lit("_")))))
    return F.coalesce(begins & (form != ""), F.lit(False))


def survivors(nodes: DataFrame) -> DataFrame:
    """(id, label, source_file): of deliveries that share an id, the definer, else the shortest label, the
    smallest label, the smallest file."""
    label, file = F.coalesce("label", F.lit("")), F.coalesce("source_file", F.lit(""))
    rank = F.struct((~defines_id(F.col("id"), file)).alias("a"), F.length(label).alias("b"), label.alias("c"), file.alias("d"))
    best = nodes.where("id is not null").groupBy("id").agg(F.min(rank).alias("r"))
    return best.select("id", F.col("r.c").alias("label"), F.col("r.d").alias("source_file"))


def namesakes(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, name, id): the node that a call of `name` in `file` means, if the rules leave one.

    Nodes of other than test files are preferred, for calls in test files those of test files; then
    the same file, the same folder, the longest common folder, each only if it leaves one node.
    Candidates are folded by (name, folder prefix) first, so that namesakes are never paired."""
    path = slashes(F.coalesce("source_file", F.lit("")))
    cand = nodes.select(bare_name(F.col("label")).alias("name"), "id", path.alias("file")).where("name <> '' and id is not null")
    cand = cand.withColumn("test", is_test_path(F.col("file")))
    count = lambda when: F.count(F.when(when, 1))
    totals = cand.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("any"), count(F.col("test")).alias("n_test"), F.min(F.when(F.col("test"), F.col("id"))).alias("id_test"), count(~F.col("test")).alias("n_code"), F.min(F.when(~F.col("test"), F.col("id"))).alias("id_code"))
    asked = calls.select("name", F.col("file")).where("name <> ''").distinct().withColumn("in_test", is_test_path(F.col("file"))).join(totals, "name")
    asked = asked.withColumn("test", F.col("in_test") & (F.col("n_test") > 0))
    left, only = F.when(F.col("test"), F.col("n_test")).otherwise(F.col("n_code")), F.when(F.col("test"), F.col("id_test")).otherwise(F.col("id_code"))
    plain = F.when(F.col("n") == 1, F.col("any")).when(left == 1, only)
    open_ = asked.where((F.col("n") > 1) & (left > 1) & (F.coalesce("file", F.lit("")) != ""))

    folders = lambda c: F.slice(F.split(c, "/"), F.lit(1), F.size(F.split(c, "/")) - 1)
    # depth 0 is the file itself, 1 its own folder, then common prefixes by length
    def places(df: DataFrame) -> DataFrame:
        own = F.array(F.struct(F.lit("file").alias("level"), F.lit(0).alias("depth"), F.col("file").alias("place")), F.struct(F.lit("folder").alias("level"), F.lit(0).alias("depth"), F.array_join(folders(F.col("file")), "/").alias("place")))
        up = F.when(F.size(folders(F.col("file"))) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders(F.col("file"))), F.lit(1))), lambda i: F.struct(F.lit("prefix").alias("level"), i.cast("int").alias("depth"), F.array_join(F.slice(folders(F.col("file")), F.lit(1), i), "/").alias("place")))).otherwise(F.array().cast("array<struct<level:string,depth:int,place:string>>"))
        return df.withColumn("p", F.explode(F.concat(own, up))).select("*", "p.*").drop("p")

    index = places(cand).groupBy("name", "test", "level", "depth", "place").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    met = places(open_.select("name", "file", "test")).join(index, ["name", "test", "level", "depth", "place"])
    order = F.when(F.col("level") == "file", 1 << 20).when(F.col("level") == "folder", 1 << 19).otherwise(F.col("depth"))
    nearest = met.groupBy("name", "file").agg(F.max_by(F.struct("k", "id"), order).alias("w")).where("w.k = 1").select("file", "name", F.col("w.id").alias("id"))
    return asked.select("file", "name", plain.alias("id")).where("id is not null").unionByName(nearest)


def cited(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Citations (…, node) with `id`: the node of that id, else the only node of that label, else null."""
    ids = nodes.select(F.col("id").alias("node"), F.col("id").alias("by_id")).where("node is not null")
    labels = nodes.where("label is not null").groupBy(F.col("label").alias("node")).agg(F.min("id").alias("by_label"), F.count("*").alias("n")).where("n = 1").drop("n")
    return citations.join(ids, "node", "left").join(labels, "node", "left").withColumn("id", F.coalesce("by_id", "by_label")).drop("by_id", "by_label")


def matched_communities(new: DataFrame, old: DataFrame) -> DataFrame:
    """(community, final): communities renamed after those of an earlier state (both of (id, community)).

    Greedy one-to-one matching by overlap, then smallest old, then smallest new name: pairs that are
    the best of both sides are taken, their communities leave, until none is left, which is the same
    as one pass in order. The others get the smallest unused numbers, by size and smallest member."""
    shared = new.join(old.select("id", F.col("community").alias("was")), "id").groupBy("was", "community").agg(F.count("*").alias("n"))
    open_ = stored(shared)
    taken = None
    order = F.struct(-F.col("n"), F.col("was"), F.col("community"))
    while not open_.isEmpty():
        a = open_.groupBy("was").agg(F.min(order).alias("o"))
        b = open_.groupBy("community").agg(F.min(order).alias("o"))
        pairs = stored(a.join(b, "o").select("was", "community"))
        taken = pairs if taken is None else taken.unionByName(pairs)
        open_ = stored(open_.join(pairs.select("was"), "was", "left_anti").join(pairs.select("community"), "community", "left_anti"))
    taken = new.select("community").where("false").withColumn("was", F.col("community")) if taken is None else taken
    sizes = new.where("community is not null").groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    rest = sizes.join(taken.select("community"), "community", "left_anti")
    ordered = rest.withColumn("k", F.row_number().over(Window.orderBy(F.desc("size"), "first")))  # one row per community
    # among the first (matches + others) numbers, at least as many are unused as there are others
    spare = new.sparkSession.range(0, rest.count() + taken.count()).select(F.col("id").alias("final")).join(taken.select(F.col("was").cast("long").alias("final")), "final", "left_anti")
    numbered = spare.withColumn("k", F.row_number().over(Window.orderBy("final")))  # one row per community
    named = ordered.join(numbered, "k").select("community", "final")
    return taken.select("community", F.col("was").cast("long").alias("final")).unionByName(named)
