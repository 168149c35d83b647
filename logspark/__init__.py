"""logspark: log enrichment and log analytics as Spark DataFrame operators.

Entry points: ``operators.enrich.ingest`` / ``enrich`` (write path),
``sources.store`` (stored table), ``operators.query`` / ``stats`` /
``metrics`` / ``retention`` / ``export`` (read path) and ``streaming.stream``
(Structured Streaming).
"""

__version__ = "0.1.0"
