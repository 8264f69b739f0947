"""Rule-based inference over RDF triples with PySpark DataFrames."""

from .plans.materialize import Result, materialize
from .plans.workspace import Workspace
from .settings import Settings

__all__ = ["Result", "Settings", "Workspace", "materialize"]
