"""Transcript analytics on Spark: DataFrame operators for speech-transcript data sets."""

__version__ = "0.1.0"
