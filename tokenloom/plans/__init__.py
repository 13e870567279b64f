"""Composed jobs (queue sweep, nightly rollup, queue-all) and table writers."""
