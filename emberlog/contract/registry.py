"""All queries and oracles."""

from . import detection, io, mining, quality, text  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
