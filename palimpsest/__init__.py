"""Text-overlap and document-analytics engine on PySpark.

Functions take and return DataFrames.  Code that runs in Python workers is
pickled by value, so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
