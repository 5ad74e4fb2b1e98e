"""Classes of files by name, first line and text; which files to keep out as they may hold secrets.

All are JVM-side expressions. A null path has no class and is not sensitive; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.rules import basename

# Suffixes by class, interpreters, secret folders and names, signals of papers.
CODE_SUFFIXES = (
    "py ts tsx mts cts js jsx mjs cjs ejs ets go rs java groovy gradle cpp cc cxx c h hpp cu cuh metal rb rake swift kt kts cs scala php lua luau toc zig ps1 psm1 psd1 ex exs m mm jl vue svelte astro dart"
    " v sv svh sql r f f90 f95 f03 f08 pas pp dpr dpk lpr inc dfm lfm lpk sh bash json tf tfvars hcl dm dme dmi dmm dmf sln slnx csproj fsproj vbproj xaml razor cshtml cls trigger"
).split()
DOCUMENT_SUFFIXES = "md mdx qmd skill txt rst html yaml yml docx xlsx".split()
IMAGE_SUFFIXES = "png jpg jpeg gif webp svg".split()
VIDEO_SUFFIXES = "mp4 mov webm mkv avi m4v mp3 wav m4a ogg".split()
MANIFESTS = "apm.yml pyproject.toml go.mod pom.xml".split()
TEXT_SUFFIXES = "md mdx qmd skill txt rst html yaml yml".split()
INTERPRETERS = "python python3 python2 ruby perl node nodejs bash sh dash zsh fish ksh tcsh lua php julia Rscript".split()
ASSET_FOLDERS = r"\.(imageset|xcassets|appiconset|colorset|launchimage)(/|$)"
SECRET_FOLDERS = r"(^|/)(\.ssh|\.gnupg|\.aws|\.gcloud|secrets|\.secrets|credentials)/"
SECRET_NAMES = (r"(?i)^\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd)$", r"(?i)(aws_credentials|gcloud_credentials|service.account)")
SECRET_WORD = r"(?i)(^|[^a-zA-Z0-9])((credential|secret|passwd|password|private_key)s?|tokens?)"
SECRET_DATA = "json yaml yml toml ini cfg conf config xml properties env txt".split()
PAPER_SIGNALS = (r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b")
#: Signals that make a paper of a text, and how much of its beginning is looked at, by the rule itself.
LEAST_SIGNALS, LOOKED_AT = 3, 3000
FIRST_LINE = r"^#![ \t]*(?:\S*/)?(?:env(?:[ \t]+(?:-\S+|\w+=\S*))*[ \t]+)?(\S+)"


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.][^/]*?\.([^./]+)$", 1))


def interpreter(text: Column) -> Column:
    """Program that the first line names, also by way of env; empty if there is none."""
    return F.regexp_extract(F.regexp_extract(F.coalesce(text, F.lit("")), FIRST_LINE, 1), r"([^/]+)$", 1)


def is_paper(text: Column) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, LOOKED_AT)
    hits = F.lit(0)
    for signal in PAPER_SIGNALS:
        hits = hits + head.rlike(signal).cast("int")
    return hits >= LEAST_SIGNALS


def file_class(path: Column, text: Column) -> Column:
    """code, document, paper, image, video or null."""
    end = suffix(path)
    pdf = F.when(~path.rlike(ASSET_FOLDERS), "paper")
    return (
        F.when(path.isNull(), None)
        .when(F.lower(basename(path)).isin(MANIFESTS) | end.isin(CODE_SUFFIXES), "code")
        .when(end == "", F.when(interpreter(text).isin(INTERPRETERS), "code"))
        .when(end == "pdf", pdf)
        .when(end.isin(IMAGE_SUFFIXES), "image")
        .when(end.isin(TEXT_SUFFIXES) & is_paper(text), "paper")
        .when(end.isin(DOCUMENT_SUFFIXES), "document")
        .when(end.isin(VIDEO_SUFFIXES), "video")
    )


def is_sensitive(path: Column) -> Column:
    """Secret folders above the file; names of secret stores; words for secrets that end the name's stem or
    stand in one of at most two words, unless the file is source code."""
    name = basename(path)
    named = F.lit(False)
    for pattern in SECRET_NAMES:
        named = named | name.rlike(pattern)
    stem = F.split_part(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit(1))
    words = F.size(F.filter(F.split(stem, r"[-_\s]+"), lambda w: w != ""))
    bearing = stem.rlike(SECRET_WORD + "$") | (stem.rlike(SECRET_WORD + r"([^a-zA-Z]|$)") & (words <= 2))
    source = suffix(path).isin([s for s in CODE_SUFFIXES if s not in SECRET_DATA])
    return F.coalesce(path.rlike(SECRET_FOLDERS) | named | (bearing & ~source), F.lit(False))
