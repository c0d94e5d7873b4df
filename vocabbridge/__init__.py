"""vocabbridge: move a language model from one token vocabulary to another, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the query, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
