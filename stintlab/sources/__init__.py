"""Readers of logger recordings into narrow samples."""
