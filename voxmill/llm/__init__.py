"""Operators of a training-data pipeline: filters, fingerprints, sampling, storage, scoring.

Every module works on plain DataFrames and has its own general interface; ``queries``
applies the operators to whole tables. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
