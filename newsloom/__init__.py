"""newsloom: media-mention analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship this package's Python helpers inside the task closures, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
