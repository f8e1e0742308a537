"""Spark-native molecular-barcode analytics: UMI and cell-barcode operators over DataFrames.

Functions that run in Python workers are pickled by value, so executors need neither
this repository on their path nor a shipped archive.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
