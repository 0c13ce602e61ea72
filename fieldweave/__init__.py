"""Spark-native integration of oil-and-gas field records.

Layers, from small to large:

* ``functions``  - ``Column`` expressions (text, ratios, units, cells, shapes, scores)
* ``operators``  - ``DataFrame -> DataFrame`` building blocks (joins, numbering, aggregation)
* ``sources``    - readers and writers
* ``plans``      - the end-to-end steps a user runs (standardize, match, merge, flares, reports, ingest)
* ``streaming``  - incremental forms of the same steps
* ``catalog``    - runnable queries over the test tables, each with its SQL counterpart
"""
