"""Training-data operators: deduplication, extraction, tokenising, filtering.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` holds the
registered queries and ``queries.ORACLE_SQL`` the SQL of those that SQL can express.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
