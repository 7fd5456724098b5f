"""All registered reference-shaped queries and their SQL oracles."""

from palimpsest.plans import archive, attempts, events, evidence, expressions, gates, messages, records, replies, reports, retrieval, streams, units, validation, verdicts, windows  # noqa: F401  they register
from palimpsest.plans.registry import ORACLES, QUERIES  # noqa: F401
