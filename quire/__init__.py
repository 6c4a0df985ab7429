"""A Spark-native engine for conservative consolidation of recurring statements in large document collections."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run on executors travel with the tasks: workers need no copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])
