"""tavola: restaurant sales analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    table readers, fixture views, file import/export
functions  scalar column expressions and the fixed rule tables
operators  reports, order lifecycle, mining, recommenders, campaigns,
           forecasting and segmentation, all as DataFrame transformations
streaming  Structured Streaming versions of the live views
plans      the named queries (Spark side and DuckDB oracle text)
"""

from tavola.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
