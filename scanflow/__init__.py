"""scanflow: attention-stream analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers need not find this package on their path: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
