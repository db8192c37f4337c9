"""Concept-cohort analytics on Spark: search, harvest, refine and apply as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
