"""Spark-native analytics over a stream of wiki page edits."""

import sys

from pyspark import cloudpickle

from quillstream.session import build_session, prepare, stage, work_dir

# The few functions that run in Python workers travel with the job, so that executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "prepare", "stage", "work_dir"]
