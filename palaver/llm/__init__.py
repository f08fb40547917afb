"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
thin ``opN_*`` queries and ``oracles.py`` their SQL.
"""

import sys

from pyspark import cloudpickle

# functions travel to the workers by value: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
