"""Spark jobs that turn corpora of project files into priced model context."""

import sys

from pyspark import cloudpickle

# The few Python UDFs travel to the executors with their code, so a job runs
# without installing or shipping this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
