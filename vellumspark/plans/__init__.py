"""The registered queries and the SQL they must agree with."""

from vellumspark.plans import bundles, drafts, evidence, extensions, gate, knowledge, ledger, maintain, notes, research_drift, retrieval, reuse, search  # noqa: F401
from vellumspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
