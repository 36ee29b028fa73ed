"""Detection-event analytics on Spark DataFrames.

``functions``  column expressions (geometry, scores, text)
``operators``  DataFrame -> DataFrame building blocks
``sources`` / ``sinks``  readers and writers
``plans``      whole reports composed from operators
``streaming``  the same analytics on Structured Streaming
"""
