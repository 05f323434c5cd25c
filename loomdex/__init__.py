"""loomdex: hybrid document search (BM25 recall + vector re-rank) as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code along: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from loomdex.engine import SearchIndex  # noqa: E402
from loomdex.functions.chunk import ChunkStrategy  # noqa: E402

__all__ = ["SearchIndex", "ChunkStrategy"]
