"""Document question answering as tables: evidence selection, answer routing and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions of the package travel to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
