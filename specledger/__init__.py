"""specledger: reconcile product and specification data on Spark."""

__version__ = "0.1.0"
