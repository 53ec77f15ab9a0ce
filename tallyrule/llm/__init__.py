"""Operators for training-data pipelines; nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# executors need not have the package installed: its functions travel whole with the tasks
cloudpickle.register_pickle_by_value(sys.modules["tallyrule"])
