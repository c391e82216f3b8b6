"""Dataflow, statistics, linear algebra and statistical learning as Spark plans."""

import os

# small dense solves beside a JVM: BLAS threads cost more than they give, and may starve
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
