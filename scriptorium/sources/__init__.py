"""Readers and writers of the file shapes around transcription data."""
