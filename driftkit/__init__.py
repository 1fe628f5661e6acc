"""driftkit: leakage-free telemetry features, labels and models on Spark.

Everything is a ``DataFrame -> DataFrame`` function with column names as
parameters.  Sub-packages:

* ``sources``   - readers, test-data views, sinks
* ``functions`` - column-expression helpers (names, parsing, time)
* ``operators`` - causal windows, labels, reshaping, profiling, pruning,
                  splits, preprocessing, Gram-based linear algebra, models,
                  metrics, outliers, clustering
* ``plans``     - end-to-end flows composed from operators, plus the query
                  catalogue used by ``__spark_entry__``
* ``streaming`` - incremental ingest of the raw feed
"""

__version__ = "0.1.0"
