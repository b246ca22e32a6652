"""Registered queries over corpora whose plans nearly all count as long."""

from functools import partial

import pytest
from compare import compare, connect

from planloom.catalog import QUERIES
from planloom.oracles import ORACLES
from planloom.plans import funnel, orders


@pytest.fixture
def short_blocks(monkeypatch):
    for adapter in (orders, funnel):
        monkeypatch.setattr(adapter, "long_groups", partial(adapter.long_groups, limit=3))
        monkeypatch.setattr(adapter, "Corpus", partial(adapter.Corpus, block_steps=2))


# Queries that read no plans, or all of their plans from tables without any order.
NO_CORPUS = {
    "nth_replace", "vocab_build", "topk_predictions", "next_action_accuracy", "masked_loss", "masked_argmax",
    "problem_ids", "plan_records", "plan_sizes", "corpus_stats", "length_filter", "sample_n", "shuffle_shard",
    "group_split", "threshold_split", "split_leakage",
}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in NO_CORPUS])
def test_long_plans_give_the_same_result(name, spark, sf_dir, short_blocks):
    plans = orders.OrderPlans(spark, sf_dir).corpus()
    assert plans.long is not None and not plans.long.isEmpty() and plans.block_steps == 2
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None
