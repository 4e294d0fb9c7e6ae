"""Search, trend and popularity analytics over media transcripts, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions handed to Arrow operators travel by value, so executors do not need the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
