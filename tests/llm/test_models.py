"""Trained models against plain arithmetic: n-gram hashes, naive Bayes, label model, scorer, class bigrams."""

import collections
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import brown, language, quality, toxicity

SF_DIR = "/root/testdata/sf0.001"
WORD = 0xFFFFFFFF


def grams(text, orders, bits):
    """Buckets of the n-grams of one text, one n-gram at a time."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    code = [ord(c) for c in " " + "".join(r + " " for r in runs)] if text else []
    for n in orders:
        for start in range(len(code) - n + 1):
            key = code[start] * 0x9E3779B1 & WORD
            for c in code[start + 1:start + n]:
                key = (key ^ key >> 15) * 0x85EBCA6B + c * 0x9E3779B1 & WORD
            mixed = ((code[start] if n == 1 else key) ^ n) * 0xC2B2AE35 & WORD
            yield (mixed ^ mixed >> 16) >> 32 - bits


def short_documents(spark, columns):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(70)
    return rows.select(*columns)


def test_naive_bayes_against_plain_counts(spark):
    docs = short_documents(spark, ["doc_id", "text", "lang"])
    rows = docs.collect()
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(grams(r.text, language.ORDERS, language.BITS))
            texts[r.lang] += 1
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(texts) > 1
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        met = collections.Counter(grams(r.text, language.ORDERS, language.BITS))
        log = {}
        for lang, n in texts.items():
            total = sum(counts[lang].values()) + language.SMOOTHING * (1 << language.BITS)
            log[lang] = math.log(n / sum(texts.values())) + sum(
                k * math.log((counts[lang][b] + language.SMOOTHING) / total) for b, k in met.items())
        best = max(sorted(log), key=log.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()), abs=0.02)


def test_toxicity_scores_against_plain_sums(spark):
    texts = [("you vile rotten fool, get lost " if i % 3 == 0 else "a calm walk along the river bank ") + "abc" * (i % 5)
             for i in range(60)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    sets = [set(grams(t or "", toxicity.ORDERS, toxicity.BITS)) for t in texts]
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [collections.Counter(itertools.chain.from_iterable(sets[i] for i in learned if (i % 3 == 0) == of)) for of in (False, True)]
    bad = sum(i % 3 == 0 for i in learned)
    weight = {}
    for b in held[0].keys() | held[1].keys():
        clean, toxic = held[0][b], held[1][b]
        ratio = math.log((toxic + 1) / (bad + 2)) - math.log((clean + 1) / (len(learned) - bad + 2))
        error = math.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
        if toxic + clean >= toxicity.LEAST_TEXTS and abs(ratio) >= max(toxicity.LEAST_RATIO, toxicity.LEAST_ERRORS * error):
            weight[b] = ratio
    ratios = np.zeros(1 << toxicity.BITS)
    ratios[list(weight)] = list(weight.values())
    # The fit itself is held against plain arithmetic in test_stages.
    part = toxicity._part([np.array(sorted(sets[i] & weight.keys()), np.int32) for i in learned])
    fitted, bias = toxicity.fit_logistic([part], np.array([float(i % 3 == 0) for i in learned]), ratios)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for i, s in enumerate(sets):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-bias - sum(float(fitted[b]) for b in s))), abs=1e-4)


def test_label_model_against_plain_steps():
    patterns = ["00000000011", "00000000010", "10000000000", "11000010001", "00000000000"]
    counts = [50, 20, 5, 7, 3]
    size = len(quality.HEURISTICS)
    rate = [[0.4] * (size - 2) + [0.1] * 2, [0.02] * (size - 2) + [0.9] * 2]
    share = 0.85
    for _ in range(quality.ROUNDS):
        good = []
        for p in patterns:
            chance = [math.prod(r if c == "1" else 1 - r for c, r in zip(p, rate[t])) for t in (0, 1)]
            good.append(share * chance[1] / (share * chance[1] + (1 - share) * chance[0]))
        for t in (0, 1):
            weight = [n * (g if t else 1 - g) for n, g in zip(counts, good)]
            rate[t] = [min(max((sum(w for w, p in zip(weight, patterns) if p[h] == "1") + 0.1) / (sum(weight) + 0.2), 1e-3), 1 - 1e-3)
                       for h in range(size)]
        share = min(max(sum(n * g for n, g in zip(counts, good)) / sum(counts), 0.01), 0.99)
    found, rates, part = quality.expectation_maximisation(patterns, np.array(counts))
    assert np.allclose(found, good, atol=1e-6) and np.allclose(rates, rate, atol=1e-6) and part == pytest.approx(share)


def test_scorer_against_plain_steps():
    rng = np.random.default_rng(4)
    rows = [[(int(b), float(np.float32(rng.random()))) for b in rng.choice(30, 6, replace=False)] for _ in range(25)]
    soft = rng.random(25)
    table = pa.table({"buckets": pa.array([[b for b, _ in r] for r in rows], pa.list_(pa.int32())),
                      "values": pa.array([[v for _, v in r] for r in rows], pa.list_(pa.float32()))})
    weight, bias = quality.fit_scorer(table, soft)
    plain = dict.fromkeys([*range(30), "bias"], 0.0)
    moments = {b: [0.0, 0.0] for b in plain}
    for step in range(1, quality.EPOCHS + 1):
        slope = {b: quality.DECAY * w for b, w in plain.items()} | {"bias": 0.0}
        for r, wanted in zip(rows, soft):
            error = (1 / (1 + math.exp(-plain["bias"] - sum(plain[b] * v for b, v in r))) - wanted) / 25
            slope["bias"] += error
            for b, v in r:
                slope[b] += error * v
        for b, g in slope.items():
            m, s = moments[b] = [0.9 * moments[b][0] + 0.1 * g, 0.999 * moments[b][1] + 0.001 * g * g]
            plain[b] -= quality.RATE * (m / (1 - 0.9 ** step)) / (math.sqrt(s / (1 - 0.999 ** step)) + 1e-9)
    assert bias == pytest.approx(plain["bias"], abs=1e-3)
    assert all(weight[b] == pytest.approx(plain[b], abs=1e-3) for b in range(30)) and not weight[30:].any()


def test_class_scores_against_plain_counts(spark, monkeypatch):
    """Scores recomputed from the texts, given which class each word ended up in."""
    seen, plain = {}, brown._estimate

    def noted(words, shared, joint, known):
        seen.update(classes=shared.value.copy(), known=known, words={
            r.word: (r.unit, r.ending, r.c) for r in words.collect()})
        return plain(words, shared, joint, known)

    monkeypatch.setattr(brown, "_estimate", noted)
    docs = short_documents(spark, ["doc_id", "text"])
    got = {r.doc_id: r.score for r in brown.score_documents(docs).collect()}
    classes, words, k = seen["classes"], seen["words"], brown.CLASSES
    tokens = {r.doc_id: [w.decode() for w in (r.text or "").encode().lower().split()] + [brown.END] for r in docs.collect()}
    types = collections.defaultdict(collections.Counter)
    for unit, ending, c in words.values():
        if c > 0:
            types[ending][classes[unit]] += 1
    overall = sum(types.values(), collections.Counter())
    most = lambda counter: min(range(k), key=lambda c: (-counter[c], c))

    def of(word):
        unit, ending, c = words[word]
        return int(classes[unit]) if c > 0 else most(types.get(ending) or overall)

    joint, count, c = collections.Counter(), collections.Counter(), collections.Counter()
    for i, text in tokens.items():
        if not brown.held_out(i):
            c.update(text)
            for before, now in zip([brown.END, *text], text):
                joint[of(before), of(now)] += 1
                count[of(now)] += 1
    total, after = sum(count.values()), collections.Counter()
    for (b, _), n in joint.items():
        after[b] += n
    for i, text in tokens.items():
        want = 0.0
        for before, now in zip([brown.END, *text], text):
            b, n = of(before), of(now)
            share = (count[n] + 1) / (total + k)
            want += math.log10((joint[b, n] + brown.SMOOTHING * share) / (after[b] + brown.SMOOTHING))
            want += math.log10((c[now] + 1) / (count[n] + overall[n] + 1))
        assert got[i] == pytest.approx(want, rel=1e-6)
