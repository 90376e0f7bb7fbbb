"""tonewheel: analytics for industrial signals and their embedding vectors, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so no executor needs a copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
