"""Row-wise rules: normal forms, classes, predicates and scores. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.ids import folded

# Fixed values of the data model.
SYNONYMS = {"markdown": "document", "text": "document", "tool": "code", "library": "code"}
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
NOISE_LABELS = "str int float bool bytes bytearray complex object True False MagicMock Mock AsyncMock NonCallableMock NonCallableMagicMock PropertyMock patch sentinel Path Any Optional List Dict Set Tuple Union Callable Type ClassVar Final Literal Protocol Counter defaultdict OrderedDict datetime Enum os sys re json io abc typing".split()
FAMILIES = {
    "python": "py pyw",
    "js": "js jsx mjs cjs ejs ts tsx mts cts vue svelte",
    "go": "go",
    "rust": "rs",
    "jvm": "java kt kts scala",
    "c": "c h cpp cc cxx hpp",
    "ruby": "rb rake",
    "swift": "swift",
    "dotnet": "cs",
    "php": "php",
    "r": "r",
}
JSON_NOISE = "start end name id type properties value key data items title description version dependencies devdependencies peerdependencies optionaldependencies bundleddependencies bundledependencies".split()
FILE_LABELS = (".py", ".js", ".ts", ".tsx", ".java", ".go", ".rs")
MODULE_LABELS = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".kt", ".rb", ".php", ".cs", ".swift", ".vue", ".svelte")
RELATION_WORDS = {"imports_from": "imports", "rationale_for": "explains", "conceptually_related_to": "relates", "participate_in": "joins", "form": "forms"}
STATUS_ORDER = ("WRONG-BASE", "CI-FAIL", "CHANGES-REQ", "DRAFT", "STALE", "APPROVED", "PENDING", "READY")
CODE = "py pyw js jsx mjs cjs ts tsx go rs java kt kts scala c h cpp cc cxx hpp rb cs php swift lua sh json"


def file_type(value: Column) -> Column:
    low = F.lower(F.btrim(value))
    out = F.when(low.isin(*FILE_TYPES), low)
    for word, kind in SYNONYMS.items():
        out = out.when(low == word, kind)
    return out.otherwise("concept")


def confidence(value: Column) -> Column:
    return F.upper(F.btrim(F.coalesce(value, F.lit("EXTRACTED"))))


def confidence_score(score: Column, kind: Column) -> Column:
    return F.coalesce(score, F.when(kind == "INFERRED", 0.5).when(kind == "AMBIGUOUS", 0.2).otherwise(1.0))


def slashes(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./|/)+", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix without the dot, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def family(path: Column) -> Column:
    s, out = suffix(path), None
    for name, suffixes in FAMILIES.items():
        out = (F if out is None else out).when(s.isin(*suffixes.split()), name)
    return out


def cross_language(a: Column, b: Column) -> Column:
    return F.coalesce(family(a) != family(b), F.lit(False))


def category(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*CODE.split()), "code").when(s == "pdf", "paper").when(s.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), "image").otherwise("doc")


def top_folder(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_path(path: Column) -> Column:
    p = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    name = basename(p)
    return p.rlike(r"(?i)(^|/)(tests?|specs?|__tests__)(/|$)") | name.rlike(r"(?i)^test_|_test\..+$|\.test\..+$|\.spec\..+$|_spec\..+$|\.tests\.ps1$") | name.rlike(r"Tests?\.java$|Tests\.cs$")


def is_sensitive_path(path: Column) -> Column:
    name = basename(path)
    return path.rlike(r"(^|/)(\.ssh|\.gnupg|\.aws|\.gcloud|secrets|\.secrets|credentials)/") | name.rlike(r"(?i)^\.(env|envrc)(\.|$)|\.(pem|key|p12|pfx|cert|crt|der|p8)$|(\.netrc|\.pgpass|\.htpasswd)$") | name.rlike(r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$")


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """File and stub nodes, which are no real entities."""
    text = F.coalesce(label, F.lit(""))
    return (text == basename(F.coalesce(source_file, F.lit("")))) & (text != "") | text.rlike(r"^\.[^()]*\(\)$") | (text.endswith("()") & (degree <= 1))


def is_concept_node(source_file: Column) -> Column:
    path = F.coalesce(source_file, F.lit(""))
    return (path == "") | ~basename(path).contains(".")


def clean_label(label: Column) -> Column:
    return F.substring(F.regexp_replace(label, r"[\x00-\x1f\x7f]", ""), 1, 256)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.round(F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)), 6)


def shingles(text: Column, k: int = 3) -> Column:
    n = F.length(text)
    return F.when(n < k, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def bare_name(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), r"\(\)$", "")


def bare_label(label: Column) -> Column:
    """The name of a seed: casefold, without the parentheses of a callable."""
    return F.regexp_replace(folded(label), r"\(\)$", "")


def surprise(e: dict[str, Column]) -> Column:
    """How surprising an edge between two files is. `e` has conf, relation, files a and b,
    communities ca and cb, and degrees da and db."""
    cat_a, cat_b = category(e["a"]), category(e["b"])
    mixed = ((cat_a == "code") & (cat_b == "doc")) | ((cat_a == "doc") & (cat_b == "code"))
    muted = (e["conf"] == "INFERRED") & e["relation"].isin("calls", "uses") & (cross_language(e["a"], e["b"]) | mixed)
    base = F.when(muted, 0).when(e["conf"] == "AMBIGUOUS", 3).when(e["conf"] == "INFERRED", 2).otherwise(1)
    plus = F.when((cat_a != cat_b) & ~muted, 2).otherwise(0) + F.when((top_folder(e["a"]) != top_folder(e["b"])) & ~muted, 2).otherwise(0) + F.when(F.coalesce(e["ca"] != e["cb"], F.lit(False)) & ~muted, 1).otherwise(0)
    raised = F.when(e["relation"] == "semantically_similar_to", F.floor((base + plus) * 1.5)).otherwise(base + plus)
    hub = (F.least(e["da"], e["db"]) <= 2) & (F.greatest(e["da"], e["db"]) >= 5)
    return (raised + F.when(hub, 1).otherwise(0)).cast("int")


def edge_score(relation: Column, kind: Column, score: Column) -> Column:
    bonus = F.when(relation.isin("calls", "uses", "method"), 1.0).when(relation.isin("imports", "imports_from"), 0.6).when(relation == "contains", -0.2).when(relation == "rationale_for", -0.6).otherwise(0.0)
    return score + F.when(kind == "EXTRACTED", 2.0).otherwise(0.0) + bonus


def pr_status(base: Column, expected: str, ci: Column, review: Column, draft: Column, age: Column, stale: int = 14) -> Column:
    return F.when(base != expected, "WRONG-BASE").when(ci == "FAILURE", "CI-FAIL").when(review == "CHANGES_REQUESTED", "CHANGES-REQ").when(draft, "DRAFT").when(age >= stale, "STALE").when(review == "APPROVED", "APPROVED").when(ci == "PENDING", "PENDING").otherwise("READY")


def url_kind(url: Column) -> Column:
    host, path = F.parse_url(url, F.lit("HOST")), F.lower(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
    return F.when(host.rlike(r"(^|\.)(twitter\.com|x\.com)$"), "tweet").when(host.rlike(r"(^|\.)arxiv\.org$"), "arxiv").when(host.rlike(r"(^|\.)github\.com$"), "github").when(host.rlike(r"(^|\.)(youtube\.com|youtu\.be)$"), "youtube").when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.(png|jpe?g|webp|gif)$"), "image").otherwise("webpage")


def path_match(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def callable_name(label: Column) -> Column:
    """The key under which calls are resolved."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.btrim(label), r"^[()]+|[()]+$", ""), r"^\.+", ""))


def is_resolvable(file_type: Column, label: Column) -> Column:
    text = F.btrim(F.coalesce(label, F.lit("")))
    names_file = F.lit(False)
    for end in FILE_LABELS:
        names_file = names_file | text.endswith(end)
    return F.coalesce(file_type == "code", F.lit(False)) & ~names_file & (callable_name(text) != "")


def is_json_key(source_file: Column, label: Column) -> Column:
    return F.coalesce(F.lower(source_file).endswith(".json") & F.lower(F.btrim(label)).isin(JSON_NOISE), F.lit(False))


def node_kind(node_id: Column, label: Column, source_file: Column, kind: Column) -> Column:
    """Class of a node in diagrams."""
    raw, file = F.coalesce(label, F.lit("")), F.lower(F.coalesce(source_file, F.lit("")))
    low = F.lower(F.when(raw == "", F.coalesce(node_id, F.lit(""))).otherwise(raw))
    has = lambda *words: low.rlike("|".join(words))
    ends = lambda c, suffixes: c.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return (
        F.when(F.lower(F.coalesce(kind, F.lit(""))).isin("rationale", "document"), "concept")
        .when(file.contains("test") | low.startswith("test_") | file.contains("spec"), "test")
        .when(has("endpoint", "router", "api", "route"), "api")
        .when(has("cli", "command", "click", "typer"), "entry")
        .when(has("async", "await", "stream", "sse"), "async")
        .when(has("component", "props", "hook", "store") | raw.rlike("^use[A-Z_-]") | ends(file, (".tsx", ".jsx", ".vue", ".svelte")), "ui")
        .when(raw.rlike("^[A-Z]") & ~raw.endswith("()"), "klass")
        .when(ends(raw, MODULE_LABELS), "module")
        .otherwise("function")
    )


def relation_word(relation: Column) -> Column:
    text = F.btrim(F.coalesce(relation, F.lit("")))
    out = F.replace(text, F.lit("_"), F.lit(" "))
    for name, word in RELATION_WORDS.items():
        out = F.when(text == name, word).otherwise(out)
    return out


def is_public_url(url: Column) -> Column:
    """http or https, and a host that is neither local nor a private address."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    local = host.rlike(r"^(localhost|.*\.localhost|.*\.local|metadata\.google\.internal)$|^(127|10|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.")
    return F.coalesce((host != "") & ~local, F.lit(False))
