"""Every registered query outside the training-data operators."""

from weftline.operators import anchors, audits, further, graph, more, phrases, ranking, relational, scoring, selection, text, tuning, vectors, walks  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES
from weftline.sources import readers, snapshots, stores  # noqa: F401
from weftline.streaming import jobs  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
