"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quire.llm import bpe, brown, exact_dedup, html_text, language, mixing, nn_descent, quality, simhash, toxicity
from quire.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size int, row_id string, fp int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", lower(text).encode())


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls everywhere, empty, blank and very long texts, ties, repeats, clashing column names."""
    long = "word another " * 20_000
    texts = [None, "", " \t\n", "one", "Same Text here now", "same text here now", "same text here now", long, long,
             "Élan ÉLAN élan vital 日本語 🙂", "x" * 50_000]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 == 0 else f"s{i % 2}", None, "k", 1, "r", 2)
            for i, t in enumerate(texts)]
    rows += [(6, "same text here now", None, None, None, None, None, None, None)] * 2 + [(None, "one") + (None,) * 7]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def test_sql_agrees(spark):
    from check_oracles import compare

    for name in ORACLES:
        assert compare(spark, SF_DIR, name) is None


def test_exact_dedup(odd):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[lower(r.text)].append(r.doc_id)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == odd.count()
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max(i for i in ids if i is not None)
        assert not r.kept or r.doc_id == r.keep_id
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(by_digest) and set(kept.values()) == {1}
    stay = exact_dedup.drop_copies(odd)
    assert stay.columns == odd.columns and stay.count() == len(groups)
    assert exact_dedup.drop_copies(odd.limit(0)).count() == 0


def test_exact_dedup_salts_do_not_change_results(odd):
    a, b = (sorted(map(tuple, exact_dedup.exact_dedup(odd.repartition(7), salts=n).select(
        "doc_id", "keep_id", "group_size", "text_sha256").collect()), key=str) for n in (1, 32))
    assert a == b


def test_mixing(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in rows)
    again = mixing.mix(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0
    many = spark.createDataFrame(
        [(i, "w " * (1 + i % 7), "abcdef"[min(i % 11, 5)] if i % 13 else None) for i in range(6000)],
        "doc_id long, text string, source string")
    sums = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in mixing.mix(many).collect():
        s = sums[r.source]
        s[0] += r["size"]
        s[1] += r.taken
        s[2] = r.target
        assert r.source_size and r.taken <= 3 * r["size"]
    for size, taken, target in sums.values():
        assert abs(taken - target) <= 4
    assert mixing.mixed_documents(many).count() == sum(r.copies for r in mixing.mix(many).collect())


def test_targets_are_the_fixed_point_of_resharing(spark):
    sizes = {"a": 5, "b": 700, "c": 0, "d": 40, "e": 90, None: 3}
    got = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", "e", None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        capped = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not capped:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in capped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= capped
    assert got == pytest.approx(target)


def naive_fingerprint(text):
    w = words_of(text)
    shingles = [b" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, documents, odd):
    got = {r.doc_id: r for r in simhash.query(spark, SF_DIR).collect()}
    prints = {i: naive_fingerprint(t) for i, t in documents}
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert all(got[i].fingerprint == f"{p:016x}" and got[i].component_id == find(i) for i, p in prints.items())
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert {r.fp for r in found if r.doc_id in (0, 1, 2)} == {0}
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.keep_row for r in found})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_pigeonring_finds_every_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base)
    for b in base:
        for _ in range(8):
            values.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for segments in (8, 16):
        got = {(r.u, r.v) for r in simhash.linked(frame, segments).collect()}
        want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
                if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2}
        assert got == want


@pytest.fixture(scope="module")
def tokenizers_pair():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    return bpe.Tokenizer(bpe._definition(path)), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeinrst '’0é", max_size=80) | st.sampled_from(
    ["<|endoftext|>Hi<|startoftext|>", "ΑΣ ΣΑΣ İstanbul ß ﬁ", "it's I'll 'VE", "x" * 3000, "\x1c\x85\xa0\x00 a"]))
def test_bpe_is_exact(tokenizers_pair, text):
    own, library = tokenizers_pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_documents(spark, documents, odd, tokenizers_pair):
    library = tokenizers_pair[1]
    for frame, pairs in ((spark.read.parquet(f"{SF_DIR}/documents.parquet"), documents),
                         (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        want = []
        for i, t in pairs:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = map(tuple, bpe.encode_documents(frame, bpe.vocabulary_path()).collect())
        assert sorted(got, key=str) == sorted(want, key=str)
    full = bpe.encode_documents(odd, bpe.vocabulary_path(), carry_ids=True).where("doc_id = 4").first()
    assert full.decoded == "same</w> text</w> here</w> now</w>" and len(full.ids) == 4
    assert bpe.encode_documents(odd.limit(0), bpe.vocabulary_path()).count() == 0


def test_brown_base_and_gain(spark, documents, odd):
    for frame, pairs, gains in ((None, documents, True), (odd, [(r.doc_id, r.text) for r in odd.collect()], False)):
        got = (brown.query(spark, SF_DIR) if frame is None else brown.score_documents(frame)).collect()
        counts = collections.Counter()
        held = {i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in pairs}
        tokens = [(i, [*words_of(t), b" "]) for i, t in pairs]
        for i, w in tokens:
            if not held[i]:
                counts.update(w)
        n, v = sum(counts.values()), len(counts)
        want = sorted((str(i), len(w), sum(counts[x] > 0 for x in w), round(sum(
            math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in tokens)
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert all(r.train_tokens == n and r.held_out == held[r.doc_id] for r in got)
        if gains:
            unseen = [r for r in got if r.held_out]
            assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert brown.score_documents(odd.limit(0)).count() == 0


def test_brown_classes_every_word(spark):
    """Seventy thousand rare words with one ending, half of them after "aa", half after "bb"."""
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rare = [(f"{side}{i}end", side) for side in "ab" for i in range(35_000)]
    ids = itertools.filterfalse(lambda i: zlib.crc32(str(i).encode()) % 7 == 2, itertools.count())
    rows = [(next(ids), " ".join(f"{s}{s} {w} {s}{s} {s}x" for w, s in rare[n:n + 1000])) for n in range(0, len(rare), 1000)] * 2
    rows += [(held[0], "aa a20000end aa"), (held[1], "aa b20000end aa")]
    got = {r.doc_id: r for r in brown.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].base_score == got[held[1]].base_score
    assert got[held[0]].score > got[held[1]].score + 1


def test_html_articles(spark):
    for r, got in ((r, html_text.main_text(r.html)) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()):
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<p>hi", "hi"), ("a &amp;lt; b&nbsp;c", "a &lt; b c"),
    ("<nav>Menu</nav><div class='sidebar'><p>Side</div><p>Body <b>t</b>ext<p>More<div id=comments><p>Said</div>", "Body text More"),
    ("<article><h1>T</h1><script>var a='</p>'</script><p>One<form>f</form><p>Two</article><footer>F</footer>", "T One Two"),
    ("<p>" + "w " * 100_000 + "</p>", ("w " * 100_000).strip()), ("<div " * 1000, ""),
])
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


def test_html_regions_follow_surges_and_dives():
    assert html_text.regions([0, 5, 0, 0, 0, 90, 100, 3, 0, 80, 0, 0, 0, 4], 3, 80) == [(5, 10)]
    # A dive is relative: some characters left in a window end a region of long lines.
    assert html_text.regions([200, 300, 250, 5, 4, 6, 5, 200, 90], 3, 80) == [(0, 3), (5, 9)]


@pytest.mark.parametrize("name", ["site no-sidebar", "content-area has-sidebar", "post-content has-comments", "legal-article", "tag-news"])
def test_html_modifiers_are_no_furniture(name):
    assert html_text.main_text(f"<div class='{name}'><p>Body</p></div>") == "Body"
    assert html_text.main_text(f"<div class='{name} related'><article><p>Body</article><p>Other</div>") == "Body"
    assert html_text.main_text("<div class='widget'><p>Body</div>") == "Body"


def test_html_unmarked_page_keeps_short_parts():
    body, end = [f"sentence {i} of a long body that goes on and on" for i in range(200)], "a short end " * 20
    adverts = "".join(f"<div class='ad'>Buy {i}</div>" for i in range(5))
    page = f"<h1>Title</h1>{adverts}{''.join(f'<p>{x}' for x in body)}</p>{adverts}<p>{end}</p><footer>F</footer>"
    assert html_text.main_text(page) == " ".join(["Title", *body, end.strip()])


def test_html_teasers_are_not_the_article():
    body = [f"sentence {i} of a long body that goes on and on" for i in range(50)]
    cards = "".join(f"<article class='card'><h3>Teaser {i}</h3></article>" for i in range(4))
    text = html_text.main_text(f"<div>{''.join(f'<p>{x}' for x in body)}</div><nav>N</nav>{cards}")
    assert text.startswith(" ".join(body))
    two = "".join(f"<article><p>{x}</article><p>Between" for x in body[:2])
    assert html_text.main_text(two) == " ".join(body[:2])


def test_html_extra_columns_and_empty(spark):
    frame = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x</p>", 6)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_text.extract(frame).collect()), key=str) == [(1, None, "", 0), (None, "u", "x", 1)]
    assert html_text.extract(frame.limit(0)).count() == 0


def test_nn_descent_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, centres = [], rng.standard_normal((40, 16))
    for i in range(900):
        base = centres[i % 40] if i % 3 else centres[0]
        rows.append((i, (base + rng.standard_normal(16) * (0.05 if i % 2 else 0.22)).tolist(), i % 4 if i % 9 else 0))
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, rows[1][1], None),
             (1004, rows[0][1], 0), (1005, [1.0], 0), (1006, [], 0), (1007, [None] + [1.0] * 15, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS hub", "'x' AS n_links")
    got, recall = nn_descent.near_vectors(frame)
    good = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows
            if v and None not in v and k is not None and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    links, root = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, x, k), (b, y, m) in itertools.combinations(good, 2):
        if k == m and x @ y >= 0.93:
            links.update((a, b))
            p, q = sorted((find(a), find(b)))
            root[q] = p
    found = {r.vec_id: r for r in got.collect()}
    assert len(found) == len(rows) and recall >= 0.99
    right = sum(found[i].n_links == links[i] for i in found)
    assert right >= 0.99 * len(rows) and all(found[i].n_links <= links[i] for i in found)
    assert sum(found[i].component_id == find(i) for i in found) >= 0.99 * len(rows)
    assert nn_descent.near_vectors(frame.limit(0))[0].count() == 0


def test_nn_descent_rare_pairs_in_a_hot_label(spark):
    """Thirty near pairs in one label of 3,000 vectors among a thousand labels of three."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((6_000, 64))
    vectors[30:60] = vectors[:30] + 0.25 * rng.standard_normal((30, 64))
    frame = spark.createDataFrame(
        [(i, v.tolist(), 0 if i < 3_000 else i % 1_000 + 1) for i, v in enumerate(vectors)],
        "vec_id long, embedding array<double>, label int")
    got, recall = nn_descent.near_vectors(frame)
    assert {r.vec_id for r in got.where("n_links = 1").collect()} == set(range(60)) and recall == 1


def test_nn_descent_audit_without_near_pairs_is_unknown(spark):
    rows = [(i, 0, bytearray(v.tobytes())) for i, v in enumerate(np.eye(64))]
    none = spark.createDataFrame([], "u long, v long")
    for extra, want in (([], None), ([(99, 0, rows[0][2])], 0)):
        nodes = spark.createDataFrame(rows + extra, "vec_id long, label long, vec binary").selectExpr("*", "0D AS radius")
        assert nn_descent._audit(none, nn_descent.true_pairs(nodes, len(rows), math.acos(0.9))) == want


def test_toxicity_held_out(spark, odd):
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted for r in got if r.toxic)
    assert hits >= 0.7 * sum(r.toxic for r in got)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.005 * len(got)
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (5, 0), (7, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        scored = toxicity.score(odd, some).collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(odd.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_language_held_out(spark, odd):
    got = language.query(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    found = language.identify(odd).collect()
    assert len(found) == odd.count()
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in language.identify(odd.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_quality_sample_bound():
    assert quality.MOST_TRAINED == 20_000
    assert quality._edge(1.0) == (1 << 63) - 1 and quality._edge(0.5) == -1
    share = 1e4 / 1e12
    assert quality._edge(share) + (1 << 63) + 1 == int(share * (1 << 64)) > 0


def test_quality_against_labels(spark, odd):
    got = quality.query(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    found = quality.judge(odd).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert quality.judge(odd.limit(0)).count() == 0


def test_expectation_maximisation_finds_rates():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    h = len(quality.HEURISTICS)
    rate = np.where(np.arange(h) >= h - 2, [[0.2]], [[0.6]]), np.where(np.arange(h) >= h - 2, [[0.95]], [[0.05]])
    fires = rng.random((20_000, h)) < np.where(good[:, None], rate[1], rate[0])
    patterns = collections.Counter("".join("1" if x else "0" for x in row) for row in fires)
    _, found, share = quality.expectation_maximisation(list(patterns), np.array(list(patterns.values())))
    assert abs(share - good.mean()) < 0.02
    assert np.abs(found[1] - rate[1]).max() < 0.03 and np.abs(found[0] - rate[0]).max() < 0.05


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = toxicity.score(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("predicted = 0").count()
    a = corpus_pipeline.toxicity_stage(spark, docs, SF_DIR)
    assert a.columns == docs.columns and a.count() == kept
    rows = [(r.doc_id, r.text) for r in a.collect()]
    best = {}
    for i, t in rows:
        best[lower(t)] = max(i, best.get(lower(t), -1))
    a = corpus_pipeline.staged(a, "test")
    b = corpus_pipeline.staged(corpus_pipeline.exact_dedup_stage(spark, a, SF_DIR), "test")
    assert sorted(r.doc_id for r in b.collect()) == sorted(best.values())
    c = corpus_pipeline.staged(corpus_pipeline.simhash_stage(spark, b, SF_DIR), "test")
    assert c.count() == simhash.near_duplicates(b).select("component_id").distinct().count()
    d = corpus_pipeline.staged(corpus_pipeline.mixing_stage(spark, c, SF_DIR), "test")
    taken = {r.doc_id: r.copies for r in mixing.mix(c).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in d.collect()) == taken and d.columns == docs.columns
    e = corpus_pipeline.run(spark, SF_DIR)
    assert collections.Counter(r.doc_id for r in e.collect()) == taken
    assert e.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_query_is_registered():
    from __spark_entry__ import queries

    assert set(QUERIES) <= set(queries())
