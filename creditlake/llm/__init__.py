"""Operators for preparing training data: deduplication, joins, packing, mixing, extraction, scans and formatting."""

import creditlake
from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(creditlake)
