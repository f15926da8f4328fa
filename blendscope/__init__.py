"""blendscope: mixture-archetype analytics as Spark DataFrame jobs.

Members of a population are described as mixtures of a few extreme real rows;
the rest of the package analyses how members are used together.
"""

import sys

from pyspark import cloudpickle

# Batch functions are shipped to the Python workers by value, so a cluster
# needs no separate installation of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
