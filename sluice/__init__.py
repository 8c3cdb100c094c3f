"""Price pass-through analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the task, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
