"""All registered queries and their SQL, by name."""

from . import audit, cleaning, evaluation, extraction, ledger, streams, verification, visual  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
