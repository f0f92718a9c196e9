"""pixelloom: raster analytics as Spark DataFrame plans.

An image is a pixel table (one row per grid cell, one column per band).
Every operator takes DataFrames and returns lazy DataFrames.
"""

import sys

from pyspark import cloudpickle

# Python workers need not have this package on their path: what the few
# vectorised functions use travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
