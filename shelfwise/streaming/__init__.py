"""Streaming form of the catalogue loader.

The analysed workload is batch only (no time column, no late data, no state).
What streams naturally is its input: catalogue files arriving in a directory
(one CSV per category). :func:`ingest_catalogue` picks them up with the file
stream source, assigns ``product_id``, parses and flags every row, and appends
to a Parquet catalogue table that the batch analyses read.
"""

from shelfwise.streaming.ingest import catalogue_stream, ingest_catalogue

__all__ = ["catalogue_stream", "ingest_catalogue"]
