"""bitextkit: parallel-corpus curation, preference-set construction and MT
evaluation as Spark DataFrame plans.

Subpackages:
  functions  column expressions (text normalisation, tokenisers, vector math)
  operators  DataFrame-in / DataFrame-out operators (cleaning, pairs, metrics,
             rewards, significance, ledgers, batch inference)
  sources    readers and sinks (tolerant CSV, JSON, line files, logs)
  plans      fixtures derived from the test tables, query registry, SQL oracle
  streaming  stateless cleaning on streaming DataFrames
"""

import sys as _sys

from bitextkit.session import get_session, ensure_checkpoint_dir, materialize

# Ship this package's functions and classes (test generators, scorers,
# mapInPandas bodies) to Python workers by value, so executors need no
# installed copy of bitextkit.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["get_session", "ensure_checkpoint_dir", "materialize"]
