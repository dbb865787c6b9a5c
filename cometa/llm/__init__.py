"""Corpus-preparation operators for training data (one module per operator).

Functions that run in tasks are sent by value, so executors need not have this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
