"""Class scores against plain arithmetic, sums in two steps, and the end of the rounds."""

import math

import numpy as np
import pandas as pd
import pytest

from quire.llm import brown


def test_summing_in_two_steps_changes_nothing(spark, monkeypatch):
    rows = [(i, f"a{i % 7} b{i % 5} c{i % 3} a{(i * 3) % 7} word{i % 40}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(brown, "CHUNK", 300)
    whole = sorted(map(tuple, brown.score_documents(docs).collect()))
    monkeypatch.setattr(brown, "GROUP", 4)
    assert sorted(map(tuple, brown.score_documents(docs).collect())) == whole


def test_information_of_class_pairs():
    k = brown.CLASSES
    joint = np.zeros((k, 2 * k))
    joint[0, 0] = joint[1, 1] = 5
    assert brown.information(joint) == pytest.approx(1)
    joint[:2, :2] = 3
    assert brown.information(joint) == pytest.approx(0)
    assert brown.information(np.zeros((k, 2 * k))) == 0


def test_sums_of_rows_are_sums_of_counts():
    rng = np.random.default_rng(0)
    size, total, rows = brown.BLOCK * 2 * brown.CLASSES, np.zeros(brown.BLOCK * 2 * brown.CLASSES, np.int64), []
    for _ in range(5):
        cells = np.sort(rng.choice(size, 50, replace=False))
        n = rng.integers(1, 9, 50)
        total[cells] += n
        rows.append((brown._packed(np.diff(cells, prepend=0).astype(np.int32)), brown._packed(n.astype(np.int32))))
    out = brown._summed((7, 0), pd.DataFrame(rows, columns=["steps", "counts"])).iloc[0]
    again = np.zeros_like(total)
    again[np.cumsum(brown._unpacked(out["steps"], np.int32))] = brown._unpacked(out["counts"], np.int64)
    assert out["block"] == 7 and (again == total).all()


def test_scores_are_probabilities(spark):
    """With one token a text is its word and an end: all words' probabilities after a start sum to one with the unseen."""
    train = [(i, t) for i, t in enumerate(["x y", "x z", "y x x", "z", "x"] * 8) if not brown.held_out(i)]
    words = ["x", "y", "z"]
    ids = [i for i in range(10_000, 10_200) if brown.held_out(i)]
    asked = list(zip(ids, [*words, ""]))
    got = {r.doc_id: r.score for r in brown.score_documents(
        spark.createDataFrame(train + asked, "doc_id long, text string")).collect()}
    assert all(v < 0 and math.isfinite(v) for v in got.values())
    known = {i: got[i] for i, _ in asked}
    # Texts of training words are likelier the more often they were met.
    assert known[asked[0][0]] > known[asked[1][0]] and sum(10 ** v for v in known.values()) < 1
