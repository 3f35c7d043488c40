"""Location-based due diligence of dwellings on PySpark: sources, normalisers, matching, analysis, quality gates."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
