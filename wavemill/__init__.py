"""wavemill: spectral analysis of matrix collections and experiment statistics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need numpy and
# pyarrow but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
