"""Tidewright: per-source telemetry analytics on PySpark.

Operators are functions from DataFrame to DataFrame. They are grouped in
``functions`` (column expressions), ``operators`` (relational and numeric
operators), ``sources`` (scans, sinks, publication), ``models`` (regression
candidates and their search), ``plans`` (whole pipelines and the registered
queries) and ``streaming``. ``llm`` holds the text operators; nothing outside
``llm`` imports it.
"""

import sys

from pyspark import cloudpickle

# Python functions shipped to executors carry their code with them, so that an
# executor needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
