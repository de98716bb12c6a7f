"""Evaluation analytics for noisy detectors, as PySpark DataFrame jobs."""
