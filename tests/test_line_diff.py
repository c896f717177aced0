import random
import time

import pytest

from quire.operators.line_diff import aligned, line_diff, lines_of, matched


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def applied(old, new):
    """The rows of an alignment, checked to tell both versions in order."""
    rows = list(aligned(old, new))
    assert [r[1] for r in rows if r[0] != "+"] == old and [r[1] for r in rows if r[0] != "-"] == new
    assert [r[2] for r in rows if r[0] != "+"] == list(range(1, len(old) + 1))
    assert [r[3] for r in rows if r[0] != "-"] == list(range(1, len(new) + 1))
    return rows


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnopqrstuvwxyz"])
def test_alignments_are_longest(letters):
    rng = random.Random(letters)
    for _ in range(300):
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(40))] for _ in range(2))
        rows = applied(a, b)
        assert sum(r[0] == " " for r in rows) == lcs(a, b)
        numbers = [[ord(x) for x in side] for side in (a, b)]
        pairs = matched(*numbers)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))


def test_removed_lines_come_before_added_ones():
    assert [r[:2] for r in aligned(["a", "x", "b"], ["a", "y", "b"])] == [(" ", "a"), ("-", "x"), ("+", "y"), (" ", "b")]
    assert list(aligned([], [])) == [] and [r[0] for r in aligned([], ["a"])] == ["+"]
    # A line that moved is removed in one place and added in another.
    assert [r[:2] for r in aligned(["a", "b", "c"], ["b", "c", "a"])] == [("-", "a"), (" ", "b"), (" ", "c"), ("+", "a")]


@pytest.mark.parametrize("kind", ["repeated", "random", "disjoint"])
def test_many_lines_in_seconds(kind):
    rng = random.Random(1)
    n = 100_000
    if kind == "repeated":
        a, b = ["x"] * n + ["y"], ["z"] + ["x"] * (n - 7000)
    elif kind == "random":
        a = [rng.choice("abc") for _ in range(n)]
        b = [x for x in a if rng.random() < 0.9] + ["c"] * 50
        rng.shuffle(b)
    else:
        a, b = ([f"{side}{i}" for i in range(n)] for side in "ab")
    began = time.monotonic()
    rows = applied(a, b)
    assert time.monotonic() - began < 60
    if kind == "repeated":
        assert sum(r[0] == " " for r in rows) == n - 7000
    if kind == "disjoint":
        assert len(rows) == 2 * n


def test_line_diff_of_tables(spark):
    old = [(1, "a\nb\nc"), (2, "same"), (3, "gone"), (4, None), (5, ""), (6, "x\r\ny"), (None, "q"), (7, "a\n\nb\n")]
    new = [(1, "a\nc\nd"), (2, "same"), (8, "new"), (4, "t"), (5, "one\n"), (6, "x\ny"), (None, "r"), (7, "a\nb\n")]
    a, b = (spark.createDataFrame(rows, "k long, t string") for rows in (old, new))
    got = sorted(map(tuple, line_diff(a, b, "k", "t").collect()))
    assert got == [
        (1, 1, " ", "a", 1, 1), (1, 2, "-", "b", 2, None), (1, 3, " ", "c", 3, 2), (1, 4, "+", "d", None, 3),
        (5, 1, "+", "one", None, 1),
        (6, 1, "-", "x\r", 1, None), (6, 2, "+", "x", None, 1), (6, 3, " ", "y", 2, 2),
        (7, 1, " ", "a", 1, 1), (7, 2, "-", "", 2, None), (7, 3, " ", "b", 3, 2)]
    only = line_diff(a, b, "k", "t", unchanged=False)
    assert sorted(map(tuple, only.collect())) == [r for r in got if r[2] != " "]
    assert line_diff(a, a.limit(0), "k", "t").count() == 0
    assert lines_of("a\n\n") == ["a", ""]


def test_unchanged_texts_are_not_exchanged(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path in (a, b):
        spark.createDataFrame([(1, "x")], "k long, t string").write.parquet(path)
    plan = line_diff(spark.read.parquet(a), spark.read.parquet(b), "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
