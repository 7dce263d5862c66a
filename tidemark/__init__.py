"""tidemark: incremental record synchronisation and catalog analytics on Spark.

Every operator is a plain ``Column -> Column`` or ``DataFrame -> DataFrame``
function.  The sub-packages are:

* ``functions``  scalar expressions (text, identity hashes, values, paths)
* ``sources``    landed payloads, feed adapters, request messages, snapshots
* ``operators``  sync fold, change feed, source state, catalog, metrics, quality
* ``streaming``  Structured Streaming drivers around the same operators
* ``plans``      end-to-end jobs and the registered query catalogue
"""
