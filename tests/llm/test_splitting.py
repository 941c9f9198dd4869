from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st

from quarrylens.llm.splitting import split_chunks, split_text


def check(text, pieces, lines, chars, overlap):
    joined, at = "", 0
    for p in pieces:
        piece = text[p.start:p.end]
        n = piece.count("\n") + (not piece.endswith("\n"))
        assert n <= lines and len(piece) <= chars and piece
        assert p.start <= at and p.overlap_lines <= overlap
        assert text.count("\n", 0, p.start) == p.first_line and p.last_line - p.first_line + 1 == n
        joined += text[at:p.end]
        at = p.end
    assert joined == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["", "}", "  foo();", "function a() {", "x" * 30, "y;" * 40, "\tif (a) {\r", "é" * 7]), max_size=60), st.booleans(), st.integers(0, 3))
def test_pieces_are_whole_and_within_limits(rows, ends, overlap):
    text = "\n".join(rows) + ("\n" if ends else "")
    pieces = split_text(text, 12, 120, overlap)
    if text:
        check(text, pieces, 12, 120, overlap)
    n = text.count("\n") + (not text.endswith("\n")) if text else 0
    assert (len(pieces) > 1) == (n > 12 or len(text) > 120)


def test_limits_of_production():
    small = "a\n" * 180
    assert len(split_text(small)) == 1 and len(split_text(small + "b")) == 2 and len(split_text("a\r\n" * 180)) == 1
    long_line = "var x=1;" * 5_000
    pieces = split_text(long_line)
    check(long_line, pieces, 180, 12_000, 5)
    assert all(long_line[p.end - 1] == ";" for p in pieces)
    big = "x" * 100_000 + "\n" + "b();\n" * 1_000
    check(big, split_text(big), 180, 12_000, 5)
    assert split_text(None) == [] and split_text("") == []


def test_cuts_at_boundaries_with_overlap():
    text = "".join(f"function f{i}() {{\n" + "  work();\n" * 20 + "}\n\n" for i in range(12))
    pieces = split_text(text)
    check(text, pieces, 180, 12_000, 5)
    lines = text.split("\n")
    assert len(pieces) == 2 and all(lines[p.first_line + p.overlap_lines].startswith("function") for p in pieces[1:]) and pieces[1].overlap_lines == 5
    with pytest.raises(ValueError):
        split_text("a", 5, 100, 5)


def test_on_spark(spark):
    t = lambda d: datetime(2026, 1, d)
    big = "x();\n" * 400
    rows = [("A", 10, big, t(1), 0, "x"), ("b", 1, big, t(1), 0, "x"), ("B ", 1, "small", t(2), 0, "x"), ("c", None, big, None, 0, "x"), (None, 1, big, t(1), 0, "x"),
            ("d", 1, None, t(1), 0, "x"), ("e", 1, "", t(1), 0, "x"), ("f", 1, "y" * 12_001, t(1), 0, "x"), ("g", 1, "y" * 12_000, t(1), 0, "x"), ("A", 10, big, t(1), 0, "x")]
    df = spark.createDataFrame(rows, "id string, start_line int, content string, ingested_at timestamp_ntz, piece_no int, pieces string")
    got = split_chunks(df).orderBy("chunk_id", "piece_no").collect()
    assert {r["chunk_id"] for r in got} == {"a", "c", "f"}
    a = [r for r in got if r["chunk_id"] == "a"]
    assert a[0]["start_line"] == 10 and a[-1]["end_line"] == 409 and len(a) == a[0]["n_pieces"]
    assert split_chunks(df.limit(0)).count() == 0


def test_long_lines_keep_their_overlap():
    import random

    rng = random.Random(5)
    lost = cuts = 0
    for _ in range(60):
        text = "\n".join("x = 1; " * rng.choice([1, 4, 700, 900, 1500]) for _ in range(rng.randint(4, 60)))
        pieces = split_text(text)
        check(text, pieces, 180, 12_000, 5)
        for p in pieces[1:]:
            before = text[text.rfind("\n", 0, text.rfind("\n", 0, p.start)) + 1:p.start] if p.overlap_lines == 0 else ""
            cuts += 1
            # only a line too long to be repeated beside the next one may be left out
            lost += p.overlap_lines == 0 and len(before) < 1_000
    assert cuts > 100 and lost == 0
