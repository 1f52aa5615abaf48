"""Operators for large text corpora. Nothing else in the library imports this.

The functions that run on executors are shipped by value, so the workers need
Spark's Python and the public libraries, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
