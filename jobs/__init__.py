"""Runnable jobs, and the same jobs as queries. Each module has a command line: ``python -m jobs.NAME --help``."""
