"""Classes of files, secrets and context filters on small fixtures; null paths and texts too."""

from pyspark.sql import functions as F

from tessera.operators.search import context_filters
from tessera.sources import classify


def test_classes(spark):
    paper = "Abstract. We propose a journal, see doi: 10, arXiv 1706.03762 [1]"
    rows = [
        ("a/b.PY", None, "code"), ("x/go.mod", None, "code"), ("run", "#!/usr/bin/env -S python3 -u\nx", "code"), ("run", "#! /bin/bash", "code"), ("run", "#!/usr/bin/env VAR=1 node", "code"), ("run", "plain", None), ("run", None, None),
        ("p.md", paper, "paper"), ("p.md", "short [1]", "document"), ("p.md", " " * 3000 + paper, "document"), ("d.docx", paper, "document"), ("i.svg", None, "image"), ("A.xcassets/i.pdf", None, None), ("i.pdf", None, "paper"), ("v.mp4", None, "video"), ("x.unknown", None, None), (".gitignore", None, None), (None, "x", None),
    ]
    df = spark.createDataFrame(rows, "path string, text string, want string")
    got = df.select("path", "want", classify.file_class(F.col("path"), F.col("text")).alias("got")).collect()
    assert all(r.got == r.want for r in got), [tuple(r) for r in got if r.got != r.want]


def test_secrets(spark):
    yes = ["a/.ssh/x", "a/secrets/y.py", "q/.env", ".env.local", "k.PEM", "id_rsa", "x/.netrc", "api_token.txt", "credentials.json", "secret_handler.txt", "github-personal-access-token", ".token"]
    no = ["secrets", "token-economics-of-recall.md", "device_token.rb", "tokenizer.txt", "password-policy-discussion.md", "src/passwords_controller.py", "mytoken.md", None, ""]
    df = spark.createDataFrame([(p, True) for p in yes + ["service_account.yml"]] + [(p, False) for p in no[1:]], "path string, want boolean")
    got = df.select("path", "want", classify.is_sensitive(F.col("path")).alias("got")).collect()
    assert all(r.got == r.want for r in got), [tuple(r) for r in got if r.got != r.want]


def test_context_filters(spark):
    df = spark.createDataFrame([("Who CALLS this, and which módules?",), ("recall nothing",), ("",), (None,)], "q string")
    assert [r.c for r in df.select(context_filters(F.col("q")).alias("c")).collect()] == [["call", "import"], [], [], []]
