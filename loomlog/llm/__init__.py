"""Operators of a training-data pipeline: formatting, sharding, packing, mixing,
filtering, language, near and exact copies, scoring and decontamination.

Nothing outside this folder imports it. Functions that run in Python workers
travel with the job, so a worker needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
