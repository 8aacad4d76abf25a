"""Governed document retrieval, redaction and governance analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions sent to tasks carry their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
