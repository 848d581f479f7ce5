"""Operators for training-data pipelines. Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# The Python steps travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
