"""Operators for preparing training text: mixing, scanning, scoring, deduplication and filtering."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job, which then needs no copy of this package there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
