"""Transcription-quality analytics as PySpark DataFrame jobs."""
