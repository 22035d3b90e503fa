"""Guaranteed-composition curation of large tables on Spark.

Every public function takes DataFrames and returns DataFrames. See README.md.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions run by executors travel with the job, so executors
# do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
