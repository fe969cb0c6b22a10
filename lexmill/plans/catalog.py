"""All registered queries of the library outside the training-data subpackage."""

from lexmill.plans import acceptance_plans, corpus_plans, language_plans, prepared_plans, retrieval_plans, review_plans, store_plans, stream_plans, task_plans

MODULES = (retrieval_plans, corpus_plans, prepared_plans, review_plans, acceptance_plans, task_plans, store_plans, stream_plans, language_plans)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
