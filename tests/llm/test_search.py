"""Clustering, ranked search and decontamination against brute force, and on odd rows, ties and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from quire.llm import centroids, decontamination, ranked_search
from quire.llm.common import staged, with_row_id

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_clusters(rows, count=16, rounds=3):
    kept = []
    for vec_id, vector in rows:
        if vector is None or len(vector) != 64 or any(v is None or not math.isfinite(v) for v in vector):
            continue
        kept.append((vec_id, [math.floor(64 * v) for v in vector]))
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cells = [x for _, x in kept]
    centers = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:count]]

    def assign():
        out = []
        for x in cells:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centers]
            out.append((min(range(len(d)), key=lambda i: (d[i], i)), min(d)))
        return out

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for x, (c, _) in zip(cells, assign()):
            own[c].append(x)
        centers = [[sum(v) // len(own[c]) for v in zip(*own[c])] if own[c] else centers[c] for c in range(len(centers))]
    found = assign()
    inertia = collections.Counter()
    for c, d in found:
        inertia[c] += d
    return sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
                  for (i, _), (c, d) in zip(kept, found))


def clusters_of(spark, rows):
    frame = spark.createDataFrame(
        [(i, v, 7, "clash") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, centroids.clusters(frame).collect()))


def test_centroids_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(9, 64)) * 2
    rows = [(i, [float(np.float32(v)) for v in centers[i % 9] + rng.normal(size=64) * 0.2]) for i in range(700)]
    hot = rows[5][1]
    rows += [(1000 + i, hot) for i in range(400)]                     # a third of all vectors are equal
    rows += [(5, hot), (5, hot), (None, hot)]                         # repeated and null ids
    rows += [(2000, None), (2001, []), (2002, hot[:63]), (2003, hot + [0.0]), (2004, [None] + hot[1:]),
             (2005, [float("nan")] + hot[1:]), (2006, [float("inf")] + hot[1:]), (2007, [0.0] * 64)]
    assert clusters_of(spark, rows) == brute_clusters(rows)


def test_centroids_ties_few_and_no_vectors(spark):
    one, two = [1.0] * 64, [-1.0] * 64
    rows = [(i, one if i % 2 else two) for i in range(40)] + [(99, [0.0] * 64)]
    assert clusters_of(spark, rows) == brute_clusters(rows)
    assert clusters_of(spark, rows[:3]) == brute_clusters(rows[:3])
    assert clusters_of(spark, [(1, None), (2, [1.0])]) == []
    assert clusters_of(spark, []) == []
    # Components that no squared distance of 64 bits can hold are no numbers to compare.
    assert clusters_of(spark, [(1, [1e30] + one[1:]), *rows[:3]]) == brute_clusters(rows[:3])


def test_hilbert_neighbours_are_adjacent_cells():
    cells = np.array(list(itertools.product(range(8), repeat=2)))
    keys = centroids.hilbert_keys(cells, 3)
    path = [cells[i] for i in sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == 64
    assert all(np.abs(a - b).sum() == 1 for a, b in zip(path, path[1:]))


def test_box_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    pruned = 0
    for _ in range(200):
        points = rng.integers(-20, 20, 64) + rng.integers(-2, 3, (30, 64))
        centers = rng.integers(-25, 25, (16, 64))
        among = centroids.candidates(points.min(axis=0), points.max(axis=0), centers)
        every, distance = centroids.nearest(points, centers, np.arange(16))
        some, same = centroids.nearest(points, centers, among)
        assert (every == some).all() and (distance == same).all()
        pruned += 16 - len(among)
    assert pruned > 1000


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_ranked(docs, items, best):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(str(item), rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def ranked_of(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, length string")
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, query int")
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in ranked_search.ranked(d, q, **more).collect()), key=str)


def corpus(seed, n=600):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Élan", "日本語", "the", "of"]
    weights = [1 / (i + 1) for i in range(400)] + [0.05, 0.05, 2, 2]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 80])))) for i in range(n)]


@pytest.mark.parametrize("block_terms", [1 << 17, 25])
def test_ranked_against_brute_force(spark, monkeypatch, block_terms):
    monkeypatch.setattr(ranked_search, "BUCKET", 32)
    docs = corpus(1) + [(700 + i, "The w3, w7! w9") for i in range(200)]        # ties in a third of the rows
    docs += [(3, "w3 w3"), (3, "w3 w3"), (None, "w5 w6 w7"), (900, None), (901, ""), (902, "--- ..."), (903, "w1 " * 30_000)]
    items = [(i, t) for i, t in corpus(2, 25)] + [(3, "THE w3"), (30, None), (31, "?!"), (32, "nowhere"), (None, "w7 w9 of")]
    assert ranked_of(spark, docs, items, best=20, block_terms=block_terms) == brute_ranked(docs, items, 20)


def test_ranked_empty_tables(spark):
    assert ranked_of(spark, [], [(1, "a")]) == []
    assert ranked_of(spark, [(1, "a"), (2, None)], []) == []
    assert ranked_of(spark, [(1, None), (2, "..")], [(1, "a")]) == []
    assert ranked_of(spark, [(1, "a b"), (2, "a c")], [(1, "b")]) == brute_ranked([(1, "a b"), (2, "a c")], [(1, "b")], 50)


def test_bounds_lose_no_vector():
    rng = np.random.default_rng(5)
    weights = rng.integers(0, 9000, 60)
    rows = [np.sort(rng.choice(60, rng.integers(1, 25), replace=False)) for _ in range(200)]
    impacts = [rng.integers(1, 900_000, len(r)) for r in rows]
    at, found = np.repeat(np.arange(200), [len(r) for r in rows]), np.concatenate(rows)
    order = np.argsort(found, kind="stable")
    met, starts = np.unique(found[order], return_index=True)
    values = np.concatenate(impacts)[order].astype(np.int64)
    lists = np.full(60, -1)
    lists[met] = np.arange(len(met))
    bucket = {"n": 200, "lists": lists, "at": at[order], "impacts": values, "starts": np.append(starts, len(values)),
              "tops": np.maximum.reduceat(values, starts),
              "lengths": np.array([math.sqrt(float((weights[r] * v.astype(float) ** 2).sum())) for r, v in zip(rows, impacts)])}
    for _ in range(50):
        asked = rng.choice(60, 15, replace=False)
        score = np.array([sum(weights[t] * v for t, v in zip(r, x) if t in set(asked)) for r, x in zip(rows, impacts)])
        least = int(np.sort(score)[-10])
        left, exact = ranked_search.survivors(asked, weights, bucket, least)
        assert sorted(left) == sorted(np.flatnonzero(score >= max(least, 1)))
        assert (exact == score[left]).all()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_contamination(docs, items):
    spans = collections.defaultdict(set)
    for item, text in items:
        ws = words(text)
        for s in range(max(1, len(ws) - 9) if ws else 0):
            spans[tuple(ws[s:s + 10])].add("" if item is None else str(item))
    sizes = {len(w) for w in spans}
    out = []
    for i, text in docs:
        ws, hit, held = words(text), set(), set()
        for size in sizes:
            for s in range(len(ws) - size + 1):
                if (w := tuple(ws[s:s + size])) in spans:
                    hit |= set(range(s, s + size))
                    held |= spans[w]
        out.append((str(i), len(ws), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def contamination_of(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row_id int, pos string")
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, term int")
    return sorted((str(r.doc_id), *r[2:]) for r in decontamination.contamination(d, q).collect())


def leaky(rng):
    phrase = lambda n: " ".join(rng.choices([f"t{i}" for i in range(30)] + ["The", "Ñu"], k=n))
    items = [(i, phrase(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(30)]
    items += [(7, phrase(12)), (None, phrase(12)), (60, None), (61, "?!"), (62, items[5][1]), (63, "ab ab ab ab ab ab ab ab ab ab ab")]
    docs = []
    for i in range(150):
        item = rng.choice(items)[1] or ""
        cut = item.split()[rng.randrange(3):]
        docs.append((i, f"{phrase(rng.randrange(40))}, {'; '.join(cut).upper()} {phrase(rng.randrange(40))}"))
    docs += [(200 + i, items[6][1] + " and " + items[7][1]) for i in range(80)]     # one passage in a third of the rows
    docs += [(4, docs[4][1]), (None, items[3][1]), (300, None), (301, ""), (302, "..."), (303, "ab " * 5000)]
    return docs, items


def test_contamination_against_brute_force(spark):
    docs, items = leaky(random.Random(4))
    assert contamination_of(spark, docs, items) == brute_contamination(docs, items)


def test_contamination_empty_tables(spark):
    assert contamination_of(spark, [], [(1, "a b")]) == []
    assert contamination_of(spark, [(1, "a b"), (2, None)], []) == brute_contamination([(1, "a b"), (2, None)], [])
    assert contamination_of(spark, [(1, "a b")], [(1, None)]) == brute_contamination([(1, "a b")], [])


def test_proximity_matches(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(12)], k=rng.randrange(60))) for _ in range(60)]
    items = [(i, " ".join(rng.choices([f"t{i}" for i in range(14)], k=n))) for i, n in enumerate([1, 2, 3, 4, 4, 3])]
    rows = staged(with_row_id(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)), "test-rows")
    spans = staged(decontamination.windows(spark.createDataFrame(items, "item_id long, text string")), "test-spans")
    terms_ = decontamination.vocabulary(spans)
    postings = decontamination.build_index(rows, terms_)
    ranked = decontamination._ranked_windows(spans, terms_, postings)
    names = {r.term: r.word for r in terms_.collect()}
    by_win = {r.win: [names[x.term] for x in r.lists] for r in ranked.collect()}
    got = sorted(tuple(r) for r in decontamination.proximity_matches(postings, ranked, 5).collect())
    want = []
    for r in rows.collect():
        ws = r.text.split()
        for win, asked in by_win.items():
            want += [(r.row_id, p, win) for p, w in enumerate(ws) if w == asked[0] and all(
                any(x == a for x in ws[max(0, p - 5):p + 6]) for a in asked[1:])]
    assert got == sorted(want) and len(got) > 20
