"""Assayloom: collections of scientific articles to auditable measurement tables, on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the job; nothing is installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
