"""Pipeline stages: the same rows whatever the number of cores between jobs, and odd rows through the whole run."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, common, exact_dedup, mixing, simhash, toxicity

SF_DIR = "/root/testdata/sf0.001"
STAGES = {
    "toxicity": lambda docs, labels: toxicity.drop_toxic(docs, labels),
    "copies": lambda docs, labels: exact_dedup.drop_copies(docs),
    "near": lambda docs, labels: simhash.drop_near_copies(docs),
    "mix": lambda docs, labels: mixing.mixed_documents(docs),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_do_not_depend_on_cores(spark, tmp_path, monkeypatch, stage):
    """The split of a scan changes after every staged table, as when executors come and go."""
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(12, "doc_id").write.parquet(path)
    key = "spark.sql.files.minPartitionNum"
    turns = []

    def changing(frame, label, plain=common.staged):
        kept = plain(frame, label)
        turns.append(label)
        spark.conf.set(key, "2" if len(turns) % 2 else "12")
        return kept

    def run():
        return collections.Counter(tuple(r) for r in STAGES[stage](spark.read.parquet(path), labels).collect())

    want = run()
    for module in (common, mixing, simhash, toxicity):
        monkeypatch.setattr(module, "staged", changing)
    try:
        spark.conf.set(key, "12")
        assert run() == want and (turns or stage == "copies")
    finally:
        spark.conf.unset(key)


def odd_documents(spark):
    long = "word another " * 20_000
    texts = [None, "", " \t\n", "one", "Same Text here now", "same text here now", "same text here now", long, long, "Élan 🙂"]
    rows = [(i, t, None, None if i % 3 else "s", None, "k", 1) for i, t in enumerate(texts)]
    rows += [(6, "same text here now", None, None, None, None, None)] * 2 + [(None, "one", "en", "s", 3, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, row_id string, turn int")


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", odd_documents(spark)), ("empty", odd_documents(spark).limit(0))):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None), (7, 0, 0)], "doc_id long, toxic int, quality int").write.parquet(
            f"{path}/labels.parquet")
        step = docs
        labels = spark.read.parquet(f"{path}/labels.parquet")
        for stage in STAGES.values():
            step = common.staged(stage(step, labels), "test")
            assert step.columns == docs.columns
        want = collections.Counter(tuple(r) for r in bpe.encode_documents(step, bpe.vocabulary_path()).collect())
        got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, path).collect())
        assert got == want and bool(got) == (name == "odd")


def test_one_of_equal_texts_stays(spark):
    kept = exact_dedup.drop_copies(odd_documents(spark)).collect()
    texts = [(r.text or "").lower() for r in kept]
    assert len(texts) == len(set(texts))
    near = simhash.drop_near_copies(odd_documents(spark)).collect()
    prints = [simhash.fingerprint((r.text or "").encode()) for r in near]
    assert len(prints) == len(set(prints))


def test_ratios_and_fit_against_plain_arithmetic():
    """Log-count ratios and the first steps of the fit, computed row by row."""
    rng = np.random.default_rng(2)
    toxic = (np.arange(60) % 3 == 0).astype(float)
    rows = [np.flatnonzero(rng.random(40) < np.where(np.arange(40) < 10, 0.1 + 0.6 * t, 0.3)).astype(np.int32) for t in toxic]
    import pandas as pd

    clean = [sum(b in r for r, t in zip(rows, toxic) if not t) for b in range(40)]
    bad = [sum(b in r for r, t in zip(rows, toxic) if t) for b in range(40)]
    counts = pd.DataFrame({"bucket": [*range(40), -1], "clean": [*clean, 40], "toxic": [*bad, 20]})
    ratios = toxicity.log_count_ratios(counts)
    for b in range(40):
        r = math.log((bad[b] + 1) / 22) - math.log((clean[b] + 1) / 42)
        error = math.sqrt(1 / (bad[b] + 1) + 1 / (clean[b] + 1))
        telling = bad[b] + clean[b] >= toxicity.LEAST_TEXTS and abs(r) >= max(toxicity.LEAST_RATIO, toxicity.LEAST_ERRORS * error)
        assert ratios[b] == pytest.approx(r if telling else 0)
    rows = [r[ratios[r] != 0] for r in rows]
    one, bias = toxicity.fit_logistic([toxicity._part(rows)], toxic, ratios)
    some, same = toxicity.fit_logistic([toxicity._part(rows[a:a + 7]) for a in range(0, 60, 7)], toxic, ratios)
    assert np.allclose(one, some) and bias == pytest.approx(same)

    weight = {b: 0.1 for r in rows for b in r}
    base = math.log(20 / 40)
    moments = {b: [0.0, 0.0] for b in [*weight, "bias"]}
    for step in range(1, toxicity.STEPS + 1):
        slope = {b: toxicity.DECAY * w / 60 for b, w in weight.items()} | {"bias": 0.0}
        for r, t in zip(rows, toxic):
            z = base + sum(weight[b] * ratios[b] for b in r)
            error = (1 / (1 + math.exp(-max(-40, min(40, z)))) - t) / 60
            slope["bias"] += error
            for b in r:
                slope[b] += error * ratios[b]
        for b, g in slope.items():
            moments[b] = [0.9 * moments[b][0] + 0.1 * g, 0.999 * moments[b][1] + 0.001 * g * g]
            move = toxicity.RATE * (moments[b][0] / (1 - 0.9 ** step)) / (math.sqrt(moments[b][1] / (1 - 0.999 ** step)) + 1e-9)
            if b == "bias":
                base -= move
            else:
                weight[b] -= move
    assert bias == pytest.approx(base, abs=1e-6)
    assert all(one[b] == pytest.approx(w * ratios[b], abs=1e-5) for b, w in weight.items())


def test_bpe_knows_every_code_point():
    """Every character encodes as the library encodes it, alone and between letters."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.Tokenizer(bpe._definition(path))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 1 << 16):
        texts = [f"{chr(c)} a{chr(c)}b" for c in points[start:start + (1 << 16)]]
        for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert own.encode(text) == found.ids, hex(ord(text[0]))
