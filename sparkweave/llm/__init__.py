"""Operators for preparing training corpora. Nothing else in the library imports this package.

Executors need not have it installed: what runs in Python workers is shipped by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
