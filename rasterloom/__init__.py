"""Spark-native raster analytics: images as tables of pixels, regions and paths."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors inside the task, so a worker needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
