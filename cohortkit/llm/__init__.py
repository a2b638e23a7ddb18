"""Operators of a training-data pipeline: filtering, deduplication, redaction,
mixing, packing and output of text corpora.

Functions that run inside Python tasks are shipped by value, so executors need
only numpy, pyarrow and the tokenizer library, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
