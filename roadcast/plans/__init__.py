"""Query catalog: importing this package registers every query.

Registration order is the order ``queries()`` lists them: relational jobs
first, MLlib model jobs (the heaviest) last.
"""

from roadcast.plans import q_ingest, q_forecast, q_deploy, q_queue, q_evidence  # noqa: F401, I001
from roadcast.plans import q_feedback, q_validate, q_stream  # noqa: F401
from roadcast.plans import q_ml  # noqa: F401
from roadcast.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
