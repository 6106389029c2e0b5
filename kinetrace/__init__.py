"""kinetrace: behavioural time-series, tensor and corpus analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so a cluster needs no
# installed copy of this package and no shared PYTHONPATH.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
