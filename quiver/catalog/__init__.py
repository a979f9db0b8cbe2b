"""All registered queries (one per operator of the survey's inventory)."""

from quiver.catalog import (  # noqa: F401  (registration side effects)
    shaping, transforms_q, labels_q, metrics_q, sequence_q, horizons_q, model_q, edges_q, checks_q, logistic_q, wide_q,
)
from quiver.catalog.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
