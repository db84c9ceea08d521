"""Transcript and timeline analytics as Spark DataFrames, keyed by ``recording_id``."""

import sys

from pyspark import cloudpickle

# Step functions of the few Python stages travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
