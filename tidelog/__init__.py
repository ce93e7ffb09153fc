"""tidelog: storage change streams, snapshot histories and disk images as Spark tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so that a cluster's workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
