"""tidings: news-sentiment x market analytics as Spark DataFrame operators.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar helpers in :mod:`tidings.functions`). Nothing triggers a
Spark action except explicit sinks, ML ``fit`` calls and the few documented
bounded constants (e.g. five few-shot examples).
"""

from tidings.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
