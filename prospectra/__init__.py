"""Prospectra: lead qualification and corpus preparation as PySpark DataFrame jobs."""
