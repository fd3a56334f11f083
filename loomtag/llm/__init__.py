"""Training-data operators on Spark: each module is one operator, `queries` registers them.

Nothing outside this subpackage imports it. Its functions travel to the executors
by value, so that executors need numpy, pyarrow and xxhash but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
