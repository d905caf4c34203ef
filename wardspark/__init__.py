"""Governed analytics on Spark: gate, lineage, masking, detectors, evidence and training-data operators."""

import sys

from pyspark import cloudpickle

# Python workers may lack this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
