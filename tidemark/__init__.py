"""tidemark: point-in-time market data on Spark.

Functions that run in Python workers are sent by value, so executors need no copy of this package.
"""

from pyspark import cloudpickle

import tidemark as _self

cloudpickle.register_pickle_by_value(_self)

__version__ = "0.1.0"
