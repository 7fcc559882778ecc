"""Training-data operators. Nothing outside this folder imports it.

The functions that run on executors are pickled by value, so a cluster needs
Spark, numpy, pyarrow and the tokenizer libraries, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
