"""cinelake: a Spark-native recommendation-data engine.

Functions of this package that run inside Python workers (block kernels,
scorer hooks) are pickled by value, so executors need no copy of the package
on their path, wherever the driver was started from.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
