"""Spark-native triage of invoices that may have been submitted twice."""

import sys

from pyspark import cloudpickle

from twinbill.params import TriageParams

# UDF bodies travel to the executors inside the job, so workers need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["TriageParams"]
