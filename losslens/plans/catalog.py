"""All registered queries of the library's own operators."""

from losslens.plans import coding, evaluation, exchange, mixing, more, samples, streams, texts, tools, verdicts  # noqa: F401
from losslens.plans.registry import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL"]
