"""Spark analytics for co-variation in aligned sequences and related tables."""

import os

# Tasks run beside each other already, and a driver's BLAS threads may block after a fork.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
