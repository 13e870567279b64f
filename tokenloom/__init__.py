"""tokenloom: AI task-log, usage, guardrail and vector analytics as Spark jobs.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark's own expressions, joins, aggregates and windows.  Nothing is
collected to the driver except bounded, size-checked dimension data.
"""

__version__ = "0.1.0"
