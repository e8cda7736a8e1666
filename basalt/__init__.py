"""basalt: a Spark-first analytics engine for fixed-schema columnar tables."""
from basalt.errors import EngineError
from basalt.operators.predicates import Predicate
from basalt.types import ColType

__all__ = ["ColType", "Engine", "EngineError", "Predicate"]


def __getattr__(name):
    if name == "Engine":
        from basalt.api import Engine

        return Engine
    raise AttributeError(name)
