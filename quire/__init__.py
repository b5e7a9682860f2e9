"""Document pages as Spark tables.

Column functions live in ``quire.functions``, DataFrame operators in
``quire.operators``, readers and writers in ``quire.sources``, Structured
Streaming in ``quire.streaming`` and shared plan shapes in ``quire.plans``.
"""

import sys

from pyspark import cloudpickle

# the few Python helpers that run in tasks travel with them, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
