"""kinweave: a Spark engine for linked persons, kin networks and document corpora."""

__version__ = "0.1.0"
