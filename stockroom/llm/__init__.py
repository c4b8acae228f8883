"""Operators for preparing language-model training data at scale (one module per operator)."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
