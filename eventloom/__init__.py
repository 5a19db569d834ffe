"""Event and venue listings as Spark jobs: landed feeds in, merged cards and reports out."""

import sys

from pyspark import cloudpickle

# Tasks carry the package's few Python functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
