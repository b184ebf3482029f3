"""Telemetry and training-data processing on PySpark.

Every operator is a function from DataFrame to DataFrame. ``operators`` holds the
engine's own operators, ``functions`` column expressions, ``sources`` readers and
writers of wire formats, ``plans`` the graph compiler, ``streaming`` the
Structured Streaming forms and ``queries`` the registered queries. The optional
subpackage ``llm`` adds corpus operators; nothing outside it imports it.
"""

import sys

from pyspark import cloudpickle

# Functions sent to workers carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
