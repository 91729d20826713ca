"""Importing this module registers every query."""

from scanflow.plans import (  # noqa: F401
    catalog_filters,
    catalog_gaze,
    catalog_questions,
    catalog_readers,
    catalog_scoring,
    catalog_sources,
    catalog_timeline,
)
from scanflow.plans.catalog import ORACLES, QUERIES  # noqa: F401
