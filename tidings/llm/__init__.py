"""Operators of a training-data pipeline: quality rules, near-duplicate joins,
mixing, chat formatting, decontamination, sharding, secret scans, archives and
classifiers. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# The package need not be installed on the executors: what a task calls is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
