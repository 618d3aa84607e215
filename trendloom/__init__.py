"""trendloom: temporal pattern analytics and event data preparation on PySpark."""

from trendloom.engine import Options, compare, find, run, statistics
from trendloom.plans.spec import QuerySpec, Registry, compile_chains, compile_rule

__version__ = "0.2.0"
__all__ = ["Options", "QuerySpec", "Registry", "compare", "compile_chains", "compile_rule", "find", "run", "statistics"]
