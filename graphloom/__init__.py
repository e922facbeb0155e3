"""graphloom: knowledge-graph and document analytics declared as Spark DataFrame plans.

What runs inside Python workers is pickled by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
