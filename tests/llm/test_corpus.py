"""Each operator against brute force, on small rows that hold nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat_format, collection_bwt, exact_dedup, graph, language_id, licenses, mixing, ngram_join, sentencepiece_lattice, sharding, shingles, substring_dedup, topk_search

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, score string, rank int"


def make(spark, texts, first=0, ids=None, sources=None):
    rows = [((ids[i] if ids else first + i), t, "en", sources[i] if sources else f"s{i % 3}", 0, 1, "x", "y", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 5, 40, 80, 200, 3000)]
    near = [edited(rng, base[4], k % 5 + 1) for k in range(40)] + [edited(rng, base[3], 1) for _ in range(5)]
    passage = prose(rng, 30)
    shared = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(25)]
    return [None, "", "  \n\t ", "ÄB c", "äB C", "Äb c", *base, *near, *shared, base[4].upper(), base[4], base[3], "one two", "ONE  two", "a" * 350, "日本語 " * 60]


# n-gram join


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def shingle_set(text):
    w = words_of(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_join(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root, links = {d: d for d in sets}, Counter()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


@pytest.mark.parametrize("rows", [1024, 8])
def test_ngram_join(spark, texts, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", rows)  # parts of several chunks
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(make(spark, texts)).collect()}
    assert got == brute_join(list(enumerate(texts)))


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_join(make(spark, [])).count() == 0
    got = [tuple(r) for r in ngram_join.ngram_join(make(spark, ["a b", "a b", None, "A b"], ids=[5, 5, 6, 2])).collect()]
    assert sorted(got) == [(2, 1, 2, 2, 3), (5, 1, 2, 2, 3), (5, 1, 2, 2, 3), (6, 0, 6, 0, 1)]


@pytest.mark.parametrize("rows", [1024, 2])
def test_ngram_join_of_an_id_with_two_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", rows)

    def at(words, places):
        return [f"e{i}" if i in places else w for i, w in enumerate(words)]

    x = [f"w{i}" for i in range(200)]
    y = at(x, (10, 30, 50, 70))
    some = [x, y, at(y, (90, 110, 130, 150)), at(x, (95, 115, 135, 155))]  # the third links with the second only, the fourth with the first
    got = ngram_join.ngram_join(make(spark, [" ".join(t) for t in some], ids=[1, 1, 2, 3])).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 2), (1, 1, 2), (2, 1, 1), (3, 1, 1)]


def test_near_dedup_keeps_one_of_each_group(spark, texts):
    kept = ngram_join.near_dedup(make(spark, texts))
    assert kept.columns == make(spark, []).columns
    want = brute_join(list(enumerate(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c, _) in want.items() if c == d)


def test_links_drop_rows_only_below_the_bound():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)]
    for left in (40, 15):
        got = ngram_join.links_of(sets, left, 75)
        for i in range(left):
            for j in range(len(got[0])):
                a, b = sets[i], sets[j if left == 40 else j + left]
                both = len(np.intersect1d(a, b))
                assert got[i, j] == (100 * both >= 75 * (len(a) + len(b) - both) and not (left == 40 and i == j))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_shingles_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    some = [prose(rng, n) for n in (2, 700, 0, 5, 1)]
    whole = shingles.shingle_sets(some)
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(some), strict=True))
    assert [len(x) for x in whole] == [len(shingle_set(t)) for t in some]


def test_words_that_collide_modulo_a_power_of_two(spark):
    def thue(n, a, b):
        return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))

    x, y = thue(2048, "a", "b"), thue(2048, "b", "a")
    assert len(np.unique(np.concatenate(shingles.shingle_sets([x, y, x.upper()])))) == 2
    got = ngram_join.ngram_join(make(spark, [x, y, x.upper()])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1), (2, 0)]


def test_ngram_join_of_a_passage_in_many_documents(spark):
    rng = random.Random(21)
    passage = prose(rng, 40, 10**6)
    some = [f"{prose(rng, rng.randrange(5, 80), 10**6)} {passage}" for _ in range(400)]
    some += [edited(rng, some[k], 1) for k in (3, 3, 9)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(make(spark, some)).collect()}
    assert got == brute_join(list(enumerate(some)))


def test_texts_that_share_a_few_shingles_are_no_candidates(spark):
    """Whatever the order of the shingles: a sketch that is full tells none of them from others."""
    rng = random.Random(4)
    shared = [prose(rng, 7, 10**6) for _ in range(61)]
    chain = [f"{shared[i]} {prose(rng, 30, 10**6)} {shared[i + 1]}" for i in range(60)]
    copies = [" ".join(w if k > 1 else f"x{k}" for k, w in enumerate(chain[i].split(" "))) for i in (5, 17)]
    order = np.zeros(ngram_join.SKETCH, dtype=np.uint8)
    edges = ngram_join.candidates(ngram_join.prefix_entries(make(spark, chain + copies).select("doc_id", "text"), order, 75, 256), 75).collect()
    assert len(edges) == sum(brute_join(list(enumerate(chain + copies)))[d][2] for d in (60, 61)) == 2


@pytest.mark.parametrize(("short", "held"), [(64, 1 << 18), (2, 1 << 18), (64, 8)])
def test_ngram_join_counts_pairs_over_tasks(spark, texts, short, held, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "HELD", held)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(make(spark, texts)).collect()}
    assert got == brute_join(list(enumerate(texts)))


def shuffled_texts(node):
    """Rows with a text that the shuffles of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_texts(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled_texts(node.plan())
    kids = node.children()
    n = sum(shuffled_texts(kids.apply(i)) for i in range(kids.size()))
    return n + (node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" and "text#" in node.output().mkString(",") else 0)


@pytest.mark.parametrize("dedup", [ngram_join.near_dedup, exact_dedup.exact_dedup])
def test_texts_that_stay_are_not_shuffled(spark, texts, dedup, monkeypatch):
    """As with more dropped documents than may be broadcast."""
    want = sorted(r.doc_id for r in dedup(make(spark, texts)).collect())
    for module in (ngram_join, exact_dedup):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = dedup(make(spark, texts))
        assert sorted(r.doc_id for r in left.collect()) == want and len(want) < len(texts)
        assert shuffled_texts(left._jdf.queryExecution().executedPlan()) <= len(texts) - len(want) + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("rows", "keys"), [(0, 1 << 24), (0, 0), (10**5, 1 << 24)])
def test_without_drops_rows_by_id_alone(spark, rows, keys, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(graph, "FILTER_KEYS", keys)
    ids = [None, None, 0, 1, 1, 2, 3, 3, -5, 2**53 + 1, 2**53 + 2, 2**62 + 1, 2**62 + 3]
    gone = [0, 1, 3, 77, -5, 2**53 + 1, 2**62 + 3]
    docs = make(spark, list(map(str, range(len(ids)))), ids=ids)
    got = graph.without(docs, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == sorted(str(k) for k, i in enumerate(ids) if i not in gone)
    assert graph.without(docs, docs.select("doc_id").limit(0)).count() == len(ids)


# language ID


def plain_model(rows):
    """Each language's set of n-grams, by dictionaries: those of its documents, the most frequent LEARN_GRAMS."""
    grams, n_docs = {}, Counter()
    for d, text, lang in rows:
        if lang is None or zlib.crc32(str(d).encode()) % 4 == 2:
            continue
        own = set(plain_grams(text))
        n_docs[lang] += bool(own)
        grams.setdefault(lang, Counter()).update(own)
    return {x: {g for g, n in c.items() if n >= language_id.LEAST_DOCS or n_docs[x] < language_id.ENOUGH_DOCS} for x, c in grams.items()}


def plain_grams(text):
    s = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    s = re.sub(" +", " ", s)
    return [s[i : i + language_id.N] for i in range(len(s) - language_id.N + 1)]


def test_language_id_equals_plain_counting(spark, monkeypatch):
    rng = random.Random(15)
    parts = {"aa": ["tho", "sha", "ing", "er"], "bb": ["ung", "keit", "ich", "ö"], "cc": ["eau", "oi", "tion", "é"], "dd": ["tho", "ung", "eau", "q"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(rng.randrange(4, 60))), x) for i in range(500) for x in [rng.choice(list(parts))]]
    rows += [rows[3], rows[3], (900, "tho " * 40_000 + "ung", None), (901, None, "aa"), (902, "  12", "bb"), (903, "x" * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("lang_pred", "score", "held_out", "gram", "n", "share")})
    monkeypatch.setattr(language_id, "PIECE", 1 << 12)
    found = language_id.identify(docs, language_id.learn(docs)).collect()
    sets, got = plain_model(rows), {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    same = close = n = 0
    for d, text, _ in rows:
        own = plain_grams(text)
        counts = {x: sum(g in s for g in own) for x, s in sorted(sets.items())}
        best = max(counts.values())
        if not best or not any(map(str.isalpha, text or "")):
            assert got[d].lang_pred == "und" and got[d].score == 0, d
            continue
        n += 1
        same += counts.get(got[d].lang_pred) == best
        close += abs(got[d].score - best / len(own)) < 0.03
    assert same >= 0.99 * n and close >= 0.99 * n


def test_language_id(spark):
    rng = random.Random(5)
    parts = {"aa": ["tho", "sha", "ing", "er"], "bb": ["ung", "keit", "ich", "ö"], "cc": ["eau", "oi", "tion", "é"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(rng.randrange(3, 60))), x) for i in range(600) for x in [rng.choice("abc") * 2]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 -- !", None), (1003, "Eautionoi éoition", None), (None, "Ungkeit ich", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs, language_id.learn(docs)).collect()
    got = {r.doc_id: r.lang_pred for r in found}
    held = [(d, x) for d, _, x in rows if d is not None and d < 1000 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(got[d] == x for d, x in held) > 0.95 * len(held)
    assert [got[1000], got[1001], got[1002], got[1003], got[None]] == ["und", "und", "und", "cc", "bb"]
    assert all(0 <= r.score <= 1 for r in found)
    assert language_id.keep_known(docs, language_id.learn(docs)).count() == len(rows) - 3
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(empty)).collect()} == {"und"}


def test_masks_return_all_languages_of_an_ngram():
    grams = {x: np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x, n in (("aa", 500), ("bb", 250))}
    model = language_id.Model(["aa", "bb"], grams)
    mask = model.masks(grams["aa"])
    assert (mask[:250] == 3).all() and (mask & 1).all() and (mask[250:] == 1).mean() > 0.9


def test_language_id_of_more_languages_than_a_mask_has_bits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [f"l{i:02}" for i in range(70)]
    words = {x: [a + letters[i // 26] + b + letters[i % 26] for a in letters[:6] for b in letters[6:12]] for i, x in enumerate(langs)}
    rng = random.Random(6)
    rows = [(70 * k + i, " ".join(rng.choices(words[x], k=40)), x) for k in range(20) for i, x in enumerate(langs)]
    rows = [r for r in rows if r[2] != "l69" or r[0] < 700]  # the rarest
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.langs == langs and model.slots.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got == {d: x for d, _, x in rows}


def test_language_id_learns_rare_languages(spark):
    rng = random.Random(8)
    common = [" ".join("".join(rng.choices(["tho", "sha", "ing", "er"], k=3)) for _ in range(30)) for _ in range(200)]
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[i], t, "aa") for i, t in enumerate(common)]
    rows += [(ids[200], "zwölf grüne vögel", "bb"), (ids[201], "", "bb"), (ids[202], None, "bb")]
    rows += [(1001, "grüne vögel", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert got[ids[200]] == got[1001] == "bb" and got[ids[0]] == "aa"


def test_language_stage_goes_by_evidence(spark):
    rows = [(i, f"the shaing of thoer number {'abc'[i % 3]}", "aa") for i in range(40)] + [(90, "日本語の文章です", None), (91, "12", "aa"), (92, "the shaing", None)]
    rows += [(next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2), "საქართველო", "ka")]  # held out, so not learnt
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r.doc_id for r in language_id.keep_known(docs, language_id.learn(docs)).collect()}
    assert left == {r[0] for r in rows} - {90, 91}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language_id.keep_known(bare, language_id.learn(bare)).collect()} == {r[0] for r in rows} - {91}


# top-k search


def test_topk_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)).round(1))]
    rows += [(300, rows[7][1]), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (350, [0.5, 0.5]), (351, [1.0, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk_search.topk_search(frame, F.col("vec_id") % 50 == 0, block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [x for x in good if x % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q and len(good[c]) == len(good[q]))[:5]
        assert sorted(got[q]) == [(n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert topk_search.topk_search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_repeated_query_ids(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(1, 49)] + [(50, [1.0, 0.0]), (50, [-1.0, 2.0]), (50, [1.0, 0.0]), (7, [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("query", "rank", "score", "v", "dim", "d")})
    got = sorted(tuple(r) for r in topk_search.topk_search(frame, F.col("vec_id") == 50, block=1).collect())
    want = []
    for q in ([1, 0], [-1, 2]):
        best = sorted((-sum(int(256 * x) * 256 * y for x, y in zip(v, q, strict=True)), i) for i, v in rows if i != 50)[:5]
        want += [(50, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


# mixing


def brute_levels(sizes, weights, total, caps):
    level, clamped = total / sum(weights), 0
    while True:
        over = [w * level > c for w, c in zip(weights, caps, strict=True)]
        if sum(over) == clamped or all(over):
            return [c if o else w * level for w, c, o in zip(weights, caps, over, strict=True)]
        clamped = sum(over)
        level = (total - sum(c for c, o in zip(caps, over, strict=True) if o)) / sum(w for w, o in zip(weights, over, strict=True) if not o)


def test_mixing(spark):
    rng = random.Random(9)
    names = [None, "b", "a", "ä", "c"]
    rows = [(prose(rng, rng.randrange(1, 300)), names[min(4, int(rng.expovariate(0.7)))]) for _ in range(400)] + [(None, "a"), ("", None), (" \n", "z")]
    docs = make(spark, [t for t, _ in rows], sources=[s for _, s in rows])
    got = mixing.mix(docs, carry=["doc_id"]).collect()
    sizes = Counter()
    for t, s in rows:
        sizes[s] += len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, brute_levels(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), [2 * sizes[s] for s in order]), strict=True))
    taken = Counter()
    for r in got:
        n = r._copies * r._size + r._part_words
        assert r._size == len(words_of(rows[r.doc_id][0])) and r.source == rows[r.doc_id][1] and n <= 2 * r._size
        assert r._target == pytest.approx(targets[r.source]) and r._source_size == sizes[r.source]
        taken[r.source] += n
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), carry=["doc_id"]).collect()))
    again = Counter(r.doc_id for r in mixing.repeat_documents(docs).collect())
    for r in got:
        assert again[r.doc_id] in (r._copies, r._copies + 1)
    assert mixing.repeat_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    repeated = mixing.mix(make(spark, ["a b c d"] * 30, ids=[1] * 30), carry=["doc_id"]).collect()
    assert sum(r._copies * r._size + r._part_words for r in repeated) <= 240


# exact dedup


def test_exact_dedup(spark, texts):
    some = [*texts, *["Hot text"] * 50, *["hot TEXT"] * 50]
    docs = make(spark, some)
    groups = {}
    for i, t in enumerate(some):
        groups.setdefault((t or "").translate(UP), []).append(i)
    for share in (256, 4):
        got = {r.doc_id: r for r in exact_dedup.dedup_groups(docs, share).collect()}
        for t, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
                assert got[i].digest == hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == sorted(map(max, groups.values()))
    odd = make(spark, ["a", "A", "a", "b", None], ids=[1, 1, None, None, 3])
    assert sorted(str((r.doc_id, r.text.lower() if r.text else None)) for r in exact_dedup.exact_dedup(odd).collect()) == ["(1, 'a')", "(3, None)", "(None, 'b')"]
    assert exact_dedup.dedup_groups(docs.limit(0)).count() == 0


def test_exact_dedup_of_an_id_with_two_texts(spark):
    kept = exact_dedup.exact_dedup(make(spark, ["a", "b", "b"], ids=[1, 1, 2]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (2, "b")]


def test_exact_dedup_keeps_columns_of_any_name(spark):
    docs = make(spark, ["a", "A", None, "b", "b"], ids=[1, 1, None, 3, 3]).withColumns({c: F.lit(7) for c in ("digest", "_digest", "_id", "row", "id", "kept_id", "group_size")})
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").lower(), r.digest, r._id) for r in kept.collect()) == [("1", "a", 7, 7), ("3", "b", 7, 7), ("None", "", 7, 7)]


def test_misra_gries_keeps_heavy_hitters():
    import pandas as pd

    rng = random.Random(4)
    values = ["hot"] * 300 + [str(rng.randrange(500)) for _ in range(700)]
    rng.shuffle(values)
    out = next(exact_dedup.misra_gries(8)(iter([pd.DataFrame({"digest": values[i : i + 50]}) for i in range(0, 1000, 50)])))
    found = dict(zip(out.digest, out.estimate, strict=True))
    assert len(found) <= 8 and 300 - 1000 / 9 <= found["hot"] <= 300


# license scans


def test_license_expressions():
    read = lambda t: licenses.evaluate(licenses.parse_expression(t))
    assert licenses.parse_expression("MIT OR Apache-2.0 AND GPL-2.0-only WITH x-1.0 */") == ["mit", "apache-2.0", "gpl-2.0-only", "x-1.0", "with", "and", "or"]
    assert read("(MIT OR GPL-3.0-only) AND BSD-3-Clause")[0::2] == (1.0, "((mit or gpl-3.0-only) and bsd-3-clause)")
    assert read("GPL-3.0-only AND unheard-of")[0] == 0.1 and read("LGPL-2.1 WITH e")[0] == pytest.approx(0.8)
    assert licenses.parse_expression("MIT) OR x") == ["mit"] and licenses.parse_expression("(MIT") == [] == licenses.parse_expression("OR MIT")


def test_license_scan(spark):
    texts = [None, "", "é MIT License. mit-license; MIT\nLicense", "Apache license version", "under the General Public License, public license", "/* SPDX-License-Identifier: Zlib OR GPL-2.0 */ x", "submit license mit licenses", "x " * 5000 + "mit license", "SPDX license identifier none"]
    got = {r.doc_id: r for r in licenses.license_scan(make(spark, texts)).collect()}
    base = {tuple(p.split()): label for p, label in licenses.BASE.items()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        hits = sorted((k, label) for k in range(len(w)) for p, label in base.items() if tuple(w[k : k + len(p)]) == p)
        assert got[i].n_words == len(w) and sorted((m.start_word, m.label) for m in got[i].matches if m.base) == hits
    assert got[5].labels == ["gpl", "zlib"] and got[5].score == 1.0 and got[5].expressions == ["(zlib or gpl-2.0)"]
    assert got[0].labels == [] and got[0].score == 0.0
    assert licenses.license_scan(make(spark, [])).count() == 0


def test_license_scan_at_line_ends_and_repeats(spark):
    texts = ["SPDX-License-Identifier: MIT\r\nApache-2.0", "// SPDX-License-Identifier: (MIT AND EUPL-1.2) WITH x\nrest", "x SPDX-License-Identifier: Zlib", "x SPDX-License-Identifier:", "Permission is hereby granted, free of charge"]
    docs = make(spark, [*texts, *texts]).withColumns({c: F.lit(1) for c in ("n_words", "matches", "labels", "expressions")})
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert [got[i].expressions for i in range(5)] == [["mit"], ["((mit and eupl-1.2) with x)"], ["zlib"], [], []]
    assert [got[i].labels for i in range(5)] == [["mit"], ["eupl", "mit"], ["zlib"], [], ["mit"]]
    assert all(got[i][1:] == got[i + 5][1:] for i in range(5))
    assert all(licenses.PERMITS.get(x) is not None for x in {*licenses.FAMILIES.values(), *licenses.NOTICES.values(), *licenses.BASE.values()})


# chat formatting


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|end|> & &amp; <|"), (1, 1, "user", None), (1, 2, "assistant", "<|next|>x"), (1, 3, "assistant", "x"), (1, 3, "assistant", "x"), (1, 4, "us<|text|>er\n", ""),
            (2, None, None, "first"), (2, 0, "assistant", "é😀"), (None, 0, "user", "u"), (None, 1, "assistant", "& w"), (3, 0, "assistant", "")]
    rows += [(4, i, ("user", "assistant")[i // 3 % 2], f"<|end|>é{i}" * (i % 4)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("formatted", "turns", "starts", "pieces", "loss_spans")})
    got = chat_format.format_conversations(frame).withColumn("turns", chat_format.parse_turns(F.col("formatted"))).withColumn("said", chat_format.under_mask(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in got:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        if r.conv_id is None:  # each row is a conversation
            own = [x for x in own if x[3] == r.turns[0].text]
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.said == [x[3] or "" for x in own if x[2] == "assistant"]
        data = r.formatted.encode()
        assert all("<|" not in data[s.start : s.end].decode() for s in r.loss_spans)
    assert len(got) == 6 and chat_format.format_conversations(frame.limit(0)).count() == 0
    one = next(r for r in got if r.conv_id == 1).formatted
    assert one.count(chat_format.START) == 3 and one.count(chat_format.NEXT) == 3


# SentencePiece


def test_pieces_equal_the_library(spark, texts):
    import sentencepiece

    pieces = sentencepiece_lattice.Pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    some = [*texts, "  two  spaces ", "line\nbreak\t\ttab", "emoji 😀 é", "x" * 500, "\x00 \x7f", "unbelievably internationalization <s> </s> <unk>"]
    for words in (1 << 16, 3):  # nearly all words, or none, from the dictionary
        for r in sentencepiece_lattice.encode(make(spark, some), pieces, words).collect():
            assert r.ids == sp.encode(some[r.doc_id] or "", num_threads=1), some[r.doc_id]
            assert r.exact and r.n_tokens == len(r.ids) and r.decoded == (some[r.doc_id] or "")
    assert sentencepiece_lattice.encode(make(spark, []), pieces).count() == 0


def test_unigram_fold(spark):
    score = {p: (s, i) for i, (p, s) in enumerate([("a", -3.0), ("b", -3.5), ("ab", -4.0), ("ba", -5.0), ("aba", -7.1), ("bab", -6.0), ("▁", -2.0), ("▁a", -3.5)])}
    pieces = sentencepiece_lattice.Pieces(sentencepiece_lattice.UNIGRAM, True, list(score), score, unknown=99)
    rng = random.Random(6)
    words = sorted({"▁" + "".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(60)})

    def cost(cut):
        return sum(score[p][0] if p in score else -17.1 if len(p) == 1 else -1e9 for p in cut)

    def best(word):
        cuts = [[word]] if not word[1:] else [[word[:i], *rest] for i in range(1, len(word)) for rest in best_all(word[i:])] + [[word]]
        return max(map(cost, cuts))

    def best_all(word):
        return [[word]] + [[word[:i], *rest] for i in range(1, len(word)) for rest in best_all(word[i:])]

    got = {r.word: r.ids for r in sentencepiece_lattice.dictionary(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    for w in words:
        cut = pieces.viterbi(w)
        assert cost(cut) == pytest.approx(best(w)) and "".join(cut) == w
        names = {i: p for p, (_, i) in score.items()}
        assert sum(score[names[i]][0] if i != 99 else -17.1 for i in got[w]) == pytest.approx(best(w))


# suffix-array dedup


def brute_dedup(rows):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(b), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substring_dedup(spark, texts):
    rng = random.Random(8)
    passage = prose(rng, 60)
    some = [*texts, *[prose(rng, 20) + passage[k : k + 150 + k] + prose(rng, 20) for k in range(60)], "ab" * 200, passage, "é" * 120 + passage[:99]]
    got = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in substring_dedup.substring_dedup(make(spark, some)).collect())
    assert got == brute_dedup(list(enumerate(some)))
    assert substring_dedup.substring_dedup(make(spark, [])).count() == 0


def test_substring_dedup_of_repeated_and_null_ids(spark):
    rng = random.Random(10)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = sorted([(4, a), (4, a), (4, b + a), (2, b)]) + [(None, a), (None, b[:50])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, [tuple(s) for s in r.spans]) for r in substring_dedup.substring_dedup(frame).collect())
    rows[-2:] = sorted(rows[-2:], key=lambda r: r[1])
    assert got == sorted((str(d), n, s) for d, n, s, _ in brute_dedup(rows))


def test_spans_of_long_texts_in_parts(monkeypatch):
    rng = random.Random(11)
    data = [bytes(rng.choices(b"abcdef ", k=n)) for n in (50, 99, 100, 101, 5000)]
    monkeypatch.setattr(substring_dedup, "PLACE", 10)
    starts = [set(), set(), set(), set(), set()]
    for i, first, last, *_ in substring_dedup.spans(data):
        for k, f, e in zip(i, first, last, strict=True):
            assert not starts[k] & set(range(f, e + 1))
            starts[k] |= set(range(f, e + 1))
    assert [len(s) for s in starts] == [0, 0, 1, 2, 4901]


def test_collection_transform():
    rng = random.Random(1)
    for _ in range(60):
        some = [bytes(rng.choices(b"ab", k=rng.randrange(13))) for _ in range(rng.randrange(1, 8))]
        entries, alphabet = collection_bwt.build(some)
        names = list(zip(entries["text"].tolist(), entries["size"].tolist(), strict=True))
        suffixes = [some[i][len(some[i]) - n :] for i, n in names]
        key = [[c + 1 for c in s] + [0] for s in suffixes]
        assert key == sorted(key) and len(set(names)) == sum(len(t) + 1 for t in some)
        for k in range(1, len(names)):
            a, b = suffixes[k - 1], suffixes[k]
            assert entries["lcp"][k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for e, (i, n) in zip(entries, names, strict=True):
            assert e["bwt"] == collection_bwt.END if n == len(some[i]) else alphabet[e["bwt"]] == some[i][len(some[i]) - n - 1]


# sharding


def test_sharding(spark, texts):
    docs = make(spark, texts)
    got = sharding.shard(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    counts = [len(by.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values()) and len(got) == len(texts)
    assert {tuple(r) for r in got} == {tuple(r) for r in sharding.shard(docs.repartition(7)).collect()}
    hot = sharding.shard(make(spark, ["x"] * 40, ids=[1] * 30 + [None] * 10)).collect()
    assert max(Counter(r.shard for r in hot).values()) == 3 and sharding.shard(docs.limit(0)).count() == 0


def plain_ring(rows, shards, cells, nodes):
    """The walk done row by row: home loads, and for each row its home shard."""
    points = sharding.ring(shards, cells, nodes)
    home = {}
    for d in rows:
        cell = int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) % cells
        home[d] = next((s for c, s in points if c >= cell), points[0][1])
    return home


def test_sharding_against_a_plain_walk(spark):
    ids = list(range(1000, 1700))
    got = {r.doc_id: r.shard for r in sharding.shard(make(spark, ["t"] * len(ids), ids=ids)).collect()}
    home = plain_ring(ids, 16, sharding.CELLS, sharding.NODES)
    room = {s: len(ids) // 16 + (s < len(ids) % 16) for s in range(16)}
    loads = Counter(home.values())
    assert Counter(got.values()) == Counter(room)
    for s in range(16):  # a shard keeps its own rows up to its room, and no shard below it loses any
        assert sum(got[d] == s for d in ids if home[d] == s) == min(loads[s], room[s])


def plain_shards(rows, shards, cells, nodes):
    """shard and slot of each (doc_id, text), by lists and loops: the rounds of the walk over cells, then rows numbered in their cells."""
    points = sharding.ring(shards, cells, nodes)
    by_cell = {}
    for d, t in rows:
        data = (t or "").encode()
        size, crc = len(data) + 1, zlib.crc32(data)
        name = str(d) if d is not None else f"-{size}-{crc}"
        cell = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % cells
        by_cell.setdefault(cell, []).append((d is not None, d or 0, crc, size))
    room = {s: len(rows) // shards + (s < len(rows) % shards) for s in range(shards)}
    going = [(c, 0, len(x), next((i for i, (p, _) in enumerate(points) if p >= c), 0)) for c, x in by_cell.items()]
    full, placed = set(), []
    while going:
        asked = {}
        for c, lo, n, node in going:
            while points[node][1] in full:
                node = (node + 1) % len(points)
            asked.setdefault(points[node][1], []).append((hashlib.md5(f"{c}/{lo}".encode()).hexdigest(), c, lo, n, node))
        going = []
        for s, pieces in asked.items():
            for _, c, lo, n, node in sorted(pieces):
                take = min(n, room[s])
                room[s] -= take
                if take:
                    placed.append((s, c, lo, take))
                if take < n:
                    full.add(s)
                    going.append((c, lo + take, n - take, node))
    out, slot = [], Counter()
    for s, c, lo, n in sorted(placed):
        for row in sorted(by_cell[c])[lo : lo + n]:
            out.append((row[1] if row[0] else None, row[3], row[2], s, slot[s]))
            slot[s] += 1
    return out


def test_sharding_equals_plain_lists(spark, texts):
    for rows in ([(i, t) for i, t in enumerate(texts)], [(i * 37, "x" * (i % 5)) for i in range(300)] + [(5, "a"), (5, "a"), (5, "b"), (None, "c"), (None, None)]):
        got = sharding.shard(make(spark, [t for _, t in rows], ids=[d for d, _ in rows])).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(plain_shards(rows, 16, sharding.CELLS, sharding.NODES), key=str)


def test_sharding_moves_little(spark):
    ids = list(range(900))
    place = lambda ids, n: {r.doc_id: r.shard for r in sharding.shard(make(spark, ["t"] * len(ids), ids=ids), n).collect()}
    before = place(ids, 16)
    fewer, more = place(ids[:-9], 16), place(ids, 17)
    assert sum(before[d] != s for d, s in fewer.items()) < 0.05 * len(ids)
    assert sum(before[d] != s for d, s in more.items()) < 0.2 * len(ids)


def test_sharding_of_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = make(spark, [None] * 60 + ["a"] * 40 + ["b"] * 20 + ["c"] * 5, ids=[None] * 60 + [3] * 40 + [3] * 20 + [None] * 5).withColumns({c: F.lit(1) for c in ("cell", "times", "shard", "slot", "run", "first", "n", "lo")})
    got = sharding.shard(docs, 4).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter({(None, 1): 60, (3, 2): 60, (None, 2): 5})
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert sorted(map(len, by.values())) == [31, 31, 31, 32] and all(x == list(range(len(x))) for x in by.values())


def test_bounded_loads_move_only_overflow(spark):
    points = sharding.ring(4, 64, 3)
    cells = sharding.arcs(spark, points, 64).collect()
    histogram = spark.createDataFrame([(c.cell, 1 + c.cell % 3, c.node) for c in cells], "cell int, n long, node int")
    placed = sharding.place_cells(histogram, points, 4).collect()
    total = sum(1 + c.cell % 3 for c in cells)
    load = Counter()
    for p in placed:
        load[p.shard] += p.n
    assert sum(load.values()) == total and max(load.values()) - min(load.values()) <= 1
    home = Counter()
    for c in cells:
        home[points[c.node][1]] += 1 + c.cell % 3
    stayed = sum(p.n for p in placed if points[next(c.node for c in cells if c.cell == p.cell)][1] == p.shard)
    assert stayed == sum(min(home[s], load[s]) for s in range(4))


def test_substring_dedup_of_one_line_in_many_surroundings(spark, monkeypatch):
    rng = random.Random(13)
    line = "the one line that stands in every page of the site, and its end"  # below 100 bytes: no string of it alone repeats
    longer = prose(rng, 30)  # one whose strings do
    some = [f"{prose(rng, 25)}{line}{prose(rng, 25)}" for _ in range(150)] + [f"{prose(rng, rng.randrange(2, 25))}{longer}{prose(rng, 25)}" for _ in range(150)]
    some += [some[0][20:] + "x", some[3][:-9], "z" + some[200]]
    want = brute_dedup(list(enumerate(some)))
    for many, very, group, keys in ((64, 1 << 16, 2048, 1 << 24), (2, 1 << 16, 2, 1 << 24), (3, 40, 5, 3), (1 << 30, 8, 1, 1 << 24)):
        for name, value in (("MANY", many), ("VERY_MANY", very), ("GROUP", group), ("FILTER_KEYS", keys)):
            monkeypatch.setattr(substring_dedup, name, value)
        got = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in substring_dedup.substring_dedup(make(spark, some)).collect())
        assert got == want, (many, very, group)


def test_key_filter_holds_every_key(spark):
    keys = [(k * 7919 - 10**15,) for k in range(3000)]
    table = graph.key_filter(spark.createDataFrame(keys, "k long").repartition(3), 3000)
    assert graph.in_filter(table, np.array(keys)[:, 0]).all()
    assert graph.in_filter(table, np.arange(100_000)).mean() < 0.05


def test_substring_dedup_of_a_very_long_text(spark):
    rng = random.Random(17)
    long = prose(rng, 60_000, 10**5)
    some = [long[50_000:50_400], long + long[1000:1300], "x" * 130 + long[200_000:200_090]]
    docs = make(spark, some).withColumns({c: F.lit(1) for c in ("key", "runs", "first", "last", "bucket", "part", "h", "lo")})
    got = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == brute_dedup(list(enumerate(some)))


def test_pieces_of_long_texts_and_repeated_rows(spark):
    import sentencepiece

    rng = random.Random(18)
    pieces = sentencepiece_lattice.Pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    some = [prose(rng, 80_000, 10**6), "y" * 20_000, "hello there", "hello there"]
    docs = make(spark, some, ids=[1, 2, 3, 3]).withColumns({c: F.lit(1) for c in ("word", "edges", "ids", "bounds", "n", "piece", "start")})
    got = sentencepiece_lattice.encode(docs, pieces, 100).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((d, len(sp.encode(t, num_threads=1))) for d, t in zip([1, 2, 3, 3], some, strict=True))
    assert all(r.ids == sp.encode(some[r.doc_id - 1], num_threads=1) and r.exact for r in got)


def test_license_expressions_against_recursive_descent():
    """Random trees, written with the brackets that their operators need, give the tree's own value and families."""
    rng = random.Random(40)
    names = ["mit", "gpl-2.0-only", "apache-2.0", "lgpl-2.1", "nobody-1.0", "bsd-3-clause", "mpl-2.0"]
    binds = {"or": 1, "and": 2, "with": 3, "": 4}

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return "", rng.choice(names), None
        op = rng.choice(["or", "and", "or", "and", "with"])
        return op, tree(depth - 1), ("", "x-1.0", None) if op == "with" else tree(depth - 1)

    def written(t):
        op, a, b = t
        if not op:
            return a
        left = f"({written(a)})" if binds[a[0]] < binds[op] else written(a)
        right = f"({written(b)})" if binds[b[0]] <= binds[op] else written(b)
        return f"{left} {op.upper() if rng.random() < 0.5 else op} {right}"

    def value(t):
        op, a, b = t
        if not op:
            family = licenses.family(a)
            return (licenses.PERMITS[family] if family else 0.1), [family] if family else []
        (x, xs), (y, ys) = value(a), value(b)
        if op == "with":
            return min(1.0, x + 0.2), xs
        return (max if op == "or" else min)(x, y), xs + ys

    for _ in range(400):
        t = tree(4)
        text = written(t)
        got = licenses.evaluate(licenses.parse_expression(text + rng.choice(["", " */", " # note"])))
        assert (got[0], got[1]) == value(t), text
