"""folioquarry: analytics over long-form document corpora, on the DataFrame API of Spark.

Layers: ``sources`` reads and writes, ``functions`` holds column expressions and Arrow functions, ``operators``
takes and returns DataFrames, ``plans`` joins operators into whole queries, ``streaming`` does so over streams.
"""
