"""Registered queries against their SQL, and the pipeline against its operators one by one."""

import sys
from pathlib import Path

import pytest
from compare import compare, connect
from test_dedup import groups_brute, line_brute, print_brute
from test_text import contamination_brute
from tokenizers import Tokenizer

from planloom.llm import language
from planloom.llm.common import table
from planloom.llm.oracles import ORACLES
from planloom.llm.queries import QUERIES, vocabulary

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir)
    model = language.learn(docs)
    good = {r.doc_id for r in language.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    rows = line_brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good])
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    groups = groups_brute(ids, [print_brute(t) for t in texts])
    rows = [(i, t) for i, t, g in zip(ids, texts, groups) if i == g]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    gone = {r[0] for r in contamination_brute(rows, items) if r[-1]}
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows if i not in gone)
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert 0 < len(gone) < len(rows) < len(good)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir).limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert dict(stage(spark, docs, sf_dir).dtypes) == dict(docs.dtypes)


def test_stages_take_odd_rows(spark, sf_dir):
    from cases import documents, empty

    for docs in (documents(spark, 1, True), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= docs.count()
