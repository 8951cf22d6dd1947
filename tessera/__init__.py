"""tessera: sales and document analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is
collected to the driver. Sub-packages:

* ``sources``   - typed scans and sinks (sales tables, objects, index, graph)
* ``functions`` - Column-level helpers (strip, tokens, money, formatting)
* ``operators`` - sales, report, listing, indexing, retrieval, graph,
                  transcripts and data-quality operators
* ``plans``     - multi-operator jobs (indexing run, answering run, shared scans)
* ``streaming`` - incremental indexing over a file stream
"""

from tessera.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
