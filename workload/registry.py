"""All registered queries, by operator id of the survey."""

from __future__ import annotations

from . import (
    learner_queries, log_queries, metric_queries, prepare_queries, profile_queries, source_queries,
    tree_queries,
)

ALL = {}
for _module in (
    source_queries, profile_queries, prepare_queries, metric_queries, log_queries,
    learner_queries, tree_queries,
):
    ALL.update(_module.QUERIES)


def flagship(spark, sf_dir):
    from tabscout.operators.advise import rules
    from tabscout.operators.profile import profile, task_facts
    from tabscout.operators.columnstats import one_row
    from .fixtures import table

    orders = table(spark, sf_dir, "orders")
    facts = one_row(
        profile(orders, "o_orderstatus", "orders", 1), task_facts(orders, "o_orderstatus")
    )
    return rules(facts)
