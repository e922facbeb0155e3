"""Training-data pipeline operators. Nothing else in the package imports this one.

Functions of this subpackage that run inside Python workers are pickled by value, so a cluster needs only the
third-party libraries installed, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
