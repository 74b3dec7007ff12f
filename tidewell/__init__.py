"""Time-series panel analytics on Spark DataFrames.

A panel is a DataFrame ``(series_id, ts, y)``.  Operators take a DataFrame and
return a DataFrame; nothing runs until the caller asks for an action.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Executors get the small task functions with the job, not from an installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
