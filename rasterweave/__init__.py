"""Land-cover analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from rasterweave.session import checkpoint, get_spark

# functions sent to Python workers travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint", "get_spark"]
