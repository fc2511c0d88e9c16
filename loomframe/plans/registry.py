"""All queries of the content-pipeline engine; the modules register theirs on import."""

from loomframe.plans import extraction, joins, kpis, payloads, projections, scalars, sequences, streams  # noqa: F401
from loomframe.plans.base import ORACLES, QUERIES  # noqa: F401
