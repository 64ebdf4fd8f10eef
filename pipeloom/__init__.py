"""A declarative query engine on Spark: documents of clauses or of pipe stages become one lazy DataFrame."""

from pipeloom.operators.registry import QueryError, register
from pipeloom.plans.context import Callable_, Context, ScopeColumn
from pipeloom.plans.engine import Engine, Result
from pipeloom.sources.datasets import Dataset, Datasets

__all__ = ["Callable_", "Context", "Dataset", "Datasets", "Engine", "QueryError", "Result", "ScopeColumn", "register"]
