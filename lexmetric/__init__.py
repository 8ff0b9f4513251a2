"""Corpus preparation and prediction evaluation as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a Column
helper) built from Spark's own expressions, joins, windows and Arrow
functions.  Nothing here creates a session, collects rows in a loop or
windows a whole table into one partition.
"""

from lexmetric.session import build_session, prepare, shared_dir  # noqa: F401

__all__ = ["build_session", "prepare", "shared_dir"]
