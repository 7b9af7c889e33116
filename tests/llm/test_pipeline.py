"""The pipeline's stages on a small table, each judged on its own input."""

import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_corpus import UP, brute_join, prose

import corpus_pipeline
from strandline.llm.common import materialise


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = materialise(docs.unionByName(spark.createDataFrame([(9001, "1234 --", "en", "src0", 7), (9002, None, "en", None, 0)], docs.schema)), "t")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SMALL), name)
        kept[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rows, left = kept["language_id"]
    assert {r.doc_id for r in rows} - {r.doc_id for r in left} == {r.doc_id for r in rows if not re.search(r"[^\W\d_]", r.text or "")}
    rows, left = kept["exact_dedup"]
    groups = {}
    for r in rows:
        groups.setdefault(r.text.translate(UP), []).append(r.doc_id)
    assert sorted(r.doc_id for r in left) == sorted(map(max, groups.values()))
    rows, left = kept["ngram_jaccard_join"]
    want = brute_join([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in left) == sorted(d for d, (_, c, _) in want.items() if c == d)
    rows, left = kept["source_mixing"]
    assert {r.doc_id for r in left} <= {r.doc_id for r in rows} and 1.2 < sum(len(r.text) for r in left) / sum(len(r.text) for r in rows) < 1.8
    rows, left = kept["sentencepiece"]
    assert len(rows) == len(left) and all(r.exact and r.n_tokens == len(r.ids) > 0 for r in left)


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Repeated rows, a null id, nulls in every column, a very long text, and columns with names that the operators use inside."""
    rng = random.Random(31)
    texts = [prose(rng, 40) for _ in range(6)] + [prose(rng, 60_000), prose(rng, 3)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (3, texts[4], "en", "s1", 1), (None, texts[5], None, None, None), (None, None, None, None, None), (20, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = "_row row id digest kept group_size size _size place _place rank shingles d0 part rep n share score lang_pred word ids _copies edges".split()
    return materialise(docs.withColumns({c: F.lit(1) for c in names}), "odd")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_on_no_documents(spark, odd_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == corpus_pipeline.STAGES[-1][0]
    empty = stage(spark, odd_documents.limit(0), SMALL)
    assert empty.count() == 0
    got = materialise(stage(spark, odd_documents, SMALL), name)
    assert last or got.columns == odd_documents.columns == empty.columns
    rows, left = odd_documents.collect(), got.collect()
    if last:
        assert len(left) == len(rows) and all(r.exact for r in left)
        return
    texts = {(r.text or "").translate(UP) for r in rows}
    seen = {(r.text or "").translate(UP) for r in left}
    assert seen <= texts and all(r._row == 1 for r in left)
    if name == "language_id":
        assert len(left) == len(rows) - 2 and "" not in seen
    elif name == "exact_dedup":
        assert seen == texts and len(left) == len(texts)
    elif name == "ngram_jaccard_join":  # no two of these texts are alike
        assert seen == texts and all(sum(r.doc_id == i for r in left) <= 2 for i in range(8))
    else:
        assert 0 < len(left) <= 2 * len(rows)


def test_mix_keeps_columns_of_any_name(spark, odd_documents):
    from strandline.llm import mixing

    got = mixing.mix(odd_documents)
    assert set(odd_documents.columns) - set(mixing.RESULTS) == set(got.columns) - set(mixing.RESULTS) and got.count() == odd_documents.count()
