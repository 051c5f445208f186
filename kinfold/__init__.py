"""kinfold: entity resolution as lazily planned Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel with the plan, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
