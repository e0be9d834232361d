"""longtail: item-centric closed-pattern mining and corpus operators on Spark.

Functions that run on executors are pickled by value, so a cluster needs the
third-party libraries but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
