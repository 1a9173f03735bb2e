"""Gated mixture-of-experts models for two binary tasks.

What runs inside tasks is in this package. It travels with the task, so executors need NumPy and
Arrow but no installation of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
