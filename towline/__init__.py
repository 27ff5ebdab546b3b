"""Survey-catch and community-composition analytics as Spark jobs."""

import os
import sys

# Tasks are the unit of parallel work: linear algebra inside one, or on the driver, uses one thread.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark import cloudpickle  # noqa: E402

# Task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
