"""Streaming: intentionally empty.

The original has no streaming code (no watermark, window, state or
late-data handling); its author deferred a Kafka feed on purpose. Daily
loads are batch jobs over one ``service_date`` partition each — see
``odspark.sources.io.publish`` for the staged, per-date replace.
"""
