"""Spark operators for labelled feature tables and for image volumes kept as tables.

``slices`` is the central layout: one row per slice with ``case_id, z, h, w`` and
row-major ``pixels`` / ``mask`` / ``prob`` arrays.  A case is never gathered into one
row, so a case of any depth stays spread over the cluster.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Array functions travel to the executors with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
