"""The registered queries of the library and their SQL."""

from __future__ import annotations

from . import q_covariance, q_fits, q_labels, q_ratios, q_resample, q_series, q_sources  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
