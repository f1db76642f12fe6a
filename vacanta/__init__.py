"""Job-market analytics on PySpark: offers, gates, relevance, verdicts, market figures."""

__version__ = "0.1.0"
