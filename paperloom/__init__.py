"""paperloom: document processing on PySpark DataFrames.

The package registers itself for pickling by value, so Python workers need no
copy of it on their import path.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except ImportError:  # the kernels can be used without Spark
    pass

__version__ = "0.1.0"
