"""Turnloom: shared AI-chat pages in, clean conversations and printable documents out, as Spark jobs.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame),
``sources`` (readers and sinks), ``plans`` (whole jobs and the registered queries),
``streaming`` (Structured Streaming forms) and ``llm`` (training-data operators; optional,
nothing else imports it).
"""
