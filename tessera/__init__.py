"""A Spark-first analytics library: DataFrame-to-DataFrame operators, sources, models and streams."""

import os

# numpy's threaded BLAS and a JVM in one process do not go well together; Spark supplies the parallelism
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
