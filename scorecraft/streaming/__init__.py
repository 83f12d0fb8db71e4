"""Streaming.

The reference has no stream, watermark, event-time window or state: every
report is a batch computed as of a date (survey section 2.L).  Nothing is
built here on purpose; the batch reports run unchanged on a scheduled
``spark-submit`` per as-of date.
"""
