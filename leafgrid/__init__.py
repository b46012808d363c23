"""leafgrid: a PySpark-native engine for document-layout annotation data."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its Python functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
