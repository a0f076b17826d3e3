"""quillspark: a Spark-native engine for corpus search, corpus statistics and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value: a cluster's executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
