"""Change-pair analytics as Spark DataFrame jobs.

``functions``  column expressions (no Python UDF)
``operators``  DataFrame in, DataFrame out
``plans``      whole workflows composed from operators, and the long reports
``sources``    readers and writers
``streaming``  incremental patch labeling
``checks``     queries over the given tables with their SQL counterparts
"""
