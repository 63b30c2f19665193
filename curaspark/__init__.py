"""Curation and evaluation analytics for self-improving models, as Spark DataFrames.

Sub-packages
------------
functions   Column -> Column expressions (parsing, answers, images, token arrays)
operators   DataFrame -> DataFrame operators (votes, rewards, advantages, batches, similarity, metrics)
sources     readers and writers for the tables a self-play loop leaves behind
streaming   Structured Streaming forms of the incremental operators
plans       the registered queries and the SQL each one is checked against
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship the few Python helpers that run inside tasks by value, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
