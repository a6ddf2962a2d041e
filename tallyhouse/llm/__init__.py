"""Preparing training text: chat, mixing, secrets, quality, neighbours, copies, packing, PII, tokens."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole: only the driver needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
