"""citegraph: Spark-native analytics for publication and collaboration data.

Every operator takes and returns Spark DataFrames. Sub-packages:

* ``sources``   - scans and sinks (JSON / CSV / parquet shards, year-partitioned tables)
* ``functions`` - Column-level helpers (name sanitising, tokens, safe casts)
* ``operators`` - relational, graph, text, clustering and scoring operators
* ``plans``     - stand-in inputs derived from the test tables, the query catalog
                  and the SQL oracles used to check it
* ``streaming`` - (intentionally small) the reference has no streaming jobs
"""

from citegraph.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
