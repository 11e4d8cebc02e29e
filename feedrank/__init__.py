"""feedrank: collect, clean, de-duplicate, score and rank news items on Spark."""

import sys

from pyspark import cloudpickle

# Ship the package's functions inside the task, so that executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
