"""A document ingestion and hybrid retrieval engine on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that no executor needs an installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
