"""Factor research on (date, code) panels, expressed as Spark plans.

``functions``  Column -> Column building blocks (element-wise, rolling, text)
``operators``  DataFrame -> DataFrame operators (cross-sections, joins, evaluation,
               composition, accounting, quality, clustering)
``sources``    panel tables, ingest and sinks
``streaming``  incremental ingest with Structured Streaming
``plans``      the registered queries and their SQL counterparts
"""
