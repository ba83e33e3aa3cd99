"""Log analytics on Spark: features, anomaly detection, incidents and reports."""

import sys

from pyspark import cloudpickle

# Workers receive the package's functions by value, so a notebook or a job can
# use it without shipping an archive to the executors first.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
