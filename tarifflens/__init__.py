"""Competitor-pricing analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

from tarifflens.session import build_session, tune

# The few Python functions that run in tasks travel with the query, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "tune"]
