"""Named queries over a folder of tables, and the SQL each is checked against."""

from plumbline.plans import q_pool, q_certify, q_arms, q_metrics  # noqa: F401, I001
from plumbline.plans.registry import CATALOGUE, Query, Tables

__all__ = ["CATALOGUE", "Query", "Tables"]
