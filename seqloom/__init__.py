"""Semi-supervised labelling of sequences over similarity graphs, on PySpark."""

import sys

from pyspark import cloudpickle

# Python workers get the functions they run from the driver: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
