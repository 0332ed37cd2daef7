"""sluice: Spark-native ingestion, profiling, cleaning and chunked export of tabular data.

Every operator is a ``DataFrame -> DataFrame`` function (use with ``df.transform``)
that runs on executors; the driver only plans and handles column metadata.
"""

__version__ = "0.1.0"
