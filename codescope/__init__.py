"""Source-corpus analysis on PySpark."""

import sys

from pyspark import cloudpickle

# The parser functions travel with the job, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
