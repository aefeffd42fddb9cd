"""Imports every module that registers queries."""

from helio.plans import (q_alerts, q_projections, q_quality, q_select, q_stats,  # noqa: F401
                         q_feeds, q_forecast, q_ml, q_prepare, q_streams, q_windows)
