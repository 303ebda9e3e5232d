"""Lodesieve: content inspection of text, JSON bodies and attachments as Spark DataFrame jobs."""
