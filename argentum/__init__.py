"""Argentum: photo-catalogue search and corpus preparation on PySpark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Code that runs inside tasks travels with the task, so that executors need no
# installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
