"""Operators for preparing language-model training data.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; ``queries`` binds each of them to the given tables.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with their code, so executors need no copy
# of this package.
register_pickle_by_value(sys.modules[__name__])
