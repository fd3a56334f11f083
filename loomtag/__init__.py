"""Session-group tag mining, retrieval and ranking evaluation as DataFrame operators.

Python functions of the package travel to the executors by value, so that executors
need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
