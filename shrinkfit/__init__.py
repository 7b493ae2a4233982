"""shrinkfit: additive bias ("effects") models of user-item ratings on Spark.

Sub-packages: ``sources`` (readers, sinks, ratings view), ``functions``
(column expressions), ``operators`` (split, effects, evaluation,
correlation), ``plans`` (the end-to-end experiment and registered queries),
``streaming`` (scoring a stream with a fitted model).
"""

from .session import configure, local_session, materialize

__all__ = ["configure", "local_session", "materialize"]
