"""scorecraft: procurement and sales reports on Spark.

Layout
------
sources/    role tables bound over the driver parquet, calendar, source/sink helpers
functions/  column expressions: missing-value semantics, scalar functions, code maps, display
operators/  generic DataFrame operators: filters, projections, joins, aggregates, windows
plans/      the reports (supplier scorecard, compliance, catalogue, dashboard, line-item load)
            and one query per generic operator
streaming/  intentionally empty (the reference has no streaming)
"""
