"""hemicycle: analytics over speaker-attributed text corpora, on Spark DataFrames.

Sub-packages:

* ``functions``  Column -> Column helpers (text, dates, scores, vectors)
* ``operators``  DataFrame -> DataFrame operators
* ``sources``    archive and file scans, sinks, keyed tables
* ``streaming``  incremental ingest as a bounded stream
* ``plans``      end-to-end jobs and the registered queries with their SQL twins
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of
# this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
