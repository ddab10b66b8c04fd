"""Spark-native analytics for spoken-media archives: transcripts, edit timelines, specs and telemetry."""

__version__ = "0.1.0"
