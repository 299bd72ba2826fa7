"""Operators for preparing language-model training data, each a Spark job.

Nothing else in ``rasterjobs`` imports this subpackage, so the folder can be
removed without touching the image jobs.
"""
