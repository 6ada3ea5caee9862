"""Every query of the package with its oracle SQL."""

from mailsieve.plans import (  # noqa: F401  (importing a module registers its queries)
    corpus_queries,
    ensemble_queries,
    explain_queries,
    feature_queries,
    metric_queries,
    model_queries,
    text_queries,
    url_queries,
)
from mailsieve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
