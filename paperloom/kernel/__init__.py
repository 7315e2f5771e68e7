"""Document kernels in plain Python: testable without Spark, deterministic, one document a call."""
