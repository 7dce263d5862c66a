"""Operators for building training data from a corpus of documents and pages.

Each module holds one operator with its own general interface.  ``queries``
holds the thin registered queries over them.  Nothing outside this subpackage
imports it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Task code travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
