"""Streaming ensemble learning expressed as Spark DataFrame jobs.

Learners are rows of a table, not processes: requests fold into a table of
active models, records are routed to every active model with one join, every
learner family trains as one grouped aggregation over all of its models, and
partial predictions are combined per record by vote or mean.
"""

__version__ = "0.1.0"
