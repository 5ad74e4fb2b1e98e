"""Encoding, splitting and packing: exact round trips and invariants."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import encoding, packing, splitting

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    with open(encoding.vocabulary_path(), "rb") as file:
        data = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return encoding.Encoder(data, encoding.PUBLIC_PATTERN), tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_public_one():
    assert encoding.PUBLIC_PATTERN == tokenizers.PATTERN


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_encoding_of_any_text(both, text):
    own, reference = both
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text) and own.decode(ids).decode() == text and own.count(text) == len(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeiourstlnm'  \n\t019_-=.,ABC\x1c\x85é", max_size=120))
def test_encoding_of_words(both, text):
    own, reference = both
    assert own.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 9_999, "ab" * 9_000, "あ" * 5_000, "<|endoftext|>", "=" * 9_999, ""])
def test_long_texts(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_encode_table(spark):
    rows = [(1, "hello world", "x", [9]), (2, None, None, None), (3, "", "y", []), (4, "hello world", "z", [1])]
    got = {r.doc_id: r.ids for r in encoding.encode(spark.createDataFrame(rows, "doc_id long, text string, source string, ids array<int>")).collect()}
    assert got[2] == [] == got[3] and got[1] == got[4] == [31373, 995]
    assert encoding.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _check(text, limit, overlap):
    spans = splitting.split(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in spans)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(spans, spans[1:]))
    return spans


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab# \n\r=é", min_size=41, max_size=600), st.sampled_from([(40, 5), (40, 0), (30, 12)]))
def test_pieces_cover_the_text(text, sizes):
    _check(text, *sizes)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab# \n\r=é", min_size=61, max_size=300), st.integers(1, 60), st.data())
def test_pieces_of_any_limit_and_overlap(text, limit, data):
    _check(text, limit, data.draw(st.integers(0, limit - 1)))


@pytest.mark.parametrize("limit, overlap", [(12_000, 10_600), (1_000, 900), (1_000, 999)])
def test_pieces_of_long_overlaps(limit, overlap):
    _check("def f():\n    return 1\n\n" * 700, limit, overlap)


def test_whole_lines_are_graded():
    at, penalty = splitting.boundaries("a\n" + " " * 300 + "text\nnext\n", 1_000)
    assert dict(zip(at.tolist(), penalty.tolist()))[307] == splitting.LINE


def test_pieces_are_cut_where_they_should():
    part = "line of text that is here\n" * 30
    text = "# One\n" + part + "# Two\n" + part + "# Three\n" + part
    spans = _check(text, 1000, 50)
    assert [text[s + 50 :].split("\n")[0] for s, _ in spans[1:]] == ["# Two", "# Three"]
    _check("x" * 50_000, 12_000, 200)
    _check(("word " * 9_000).strip(), 12_000, 200)
    _check("def f():\n    pass\n" * 4_000, 12_000, 200)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=25))
def test_plan_places_every_item(histogram):
    count, patterns, order = packing.plan(histogram, 50)
    assert order in ("most room first", "least room first")
    placed, packs = {}, 0
    for first, n, items in patterns:
        assert first == packs and sum(length * times for length, times in items) <= 50
        packs += n
        for length, times in items:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram and packs == count
    assert count >= -(-sum(k * v for k, v in histogram.items()) // 50)


def _sources(spark, rows):
    return spark.createDataFrame([(i, *r, 5, "lang") for i, r in enumerate(rows)], "scan_id long, source_file string, mtime timestamp_ntz, content string, chunk int, size string")


def test_pack_table(spark):
    from datetime import datetime

    rng = random.Random(3)
    old, new = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [(f"r/f{i}", new, "x" * rng.randrange(0, 130)) for i in range(300)] + [(f"r/same{i}", new, "y" * 33) for i in range(200)]
    rows += [("r/f1", old, "z" * 500), ("r/long", new, "q" * 1234), ("r/long", new, "q" * 1234), ("r/null", new, None), (None, new, "a"), ("r/untimed", None, "abc")]
    parts = packing.pack_sources(_sources(spark, rows), 100).collect()
    want = {p: len(c) for p, t, c in rows if p and c is not None and t != old}
    spans = {}
    for p in parts:
        spans.setdefault(p.source_file, []).append((p.start, p.end))
    assert set(spans) == set(want)
    for name, found in spans.items():
        found.sort()
        assert found[0][0] == 0 and found[-1][1] == want[name] and all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert want[name] > 100 or len(found) == 1
    size, places = {}, set()
    for p in parts:
        size[p.chunk] = size.get(p.chunk, 0) + p.end - p.start
        if p.end > p.start:
            assert (p.chunk, p.place) not in places
            places.add((p.chunk, p.place))
    assert max(size.values()) <= 100 and set(size) == set(range(len(size)))
    assert len(size) <= 1.1 * sum(want.values()) / 100
    assert packing.pack_sources(_sources(spark, []), 100).count() == 0


def test_split_table(spark):
    from datetime import datetime

    old, new = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [("a", old, "x" * 300), ("a", new, "x" * 50), ("b", new, "y\n" * 200), ("b", new, "y\n" * 200), ("c", new, None), ("d", new, ""), ("e", None, "e" * 101), (None, new, "z" * 500)]
    df = _sources(spark, rows)
    with pytest.raises(ValueError):
        splitting.split_sources(df, 100, 100)
    pieces = splitting.split_sources(df, 100, 10).orderBy("source_file", "piece").collect()
    by = {}
    for p in pieces:
        by.setdefault(p.source_file, []).append(p)
    assert set(by) == {"b", "e"}
    assert by["b"][0].text + "".join(p.text[10:] for p in by["b"][1:]) == "y\n" * 200
    assert splitting.split_sources(_sources(spark, []), 100, 10).count() == 0
