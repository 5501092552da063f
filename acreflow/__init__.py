"""acreflow: a Spark-first analytics engine for farm-land data.

Functions that run in Python workers are pickled by value, so executors need
no copy of the package.
"""

from pyspark import cloudpickle as _cloudpickle

import acreflow as _self

_cloudpickle.register_pickle_by_value(_self)
