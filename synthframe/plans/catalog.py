"""All registered queries."""

from synthframe.plans import queries_model, queries_prepare, queries_score  # noqa: F401
from synthframe.plans.registry import QUERIES, callables, oracles  # noqa: F401
