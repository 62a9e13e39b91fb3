"""discloom: a PySpark-native analytics engine for regulatory disclosure filings.

Everything is a function from DataFrames to a DataFrame.  ``operators`` holds
the relational operators, ``functions`` the column expressions, ``sources``
the readers and writers, ``streaming`` the incremental jobs and ``plans`` the
named queries with their SQL counterparts.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Workers get the functions themselves, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
