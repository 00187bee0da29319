"""rareflow: rare-event detection on Spark DataFrames and streams.

Modules: ``operators`` (metrics, ordered helpers, sampling, validation, models), ``streaming``
(events, stream runs), ``sources`` (files), ``functions`` (column expressions), ``plans``
(registered queries and their SQL twins), ``runs`` (end-to-end flows), ``session``.
"""

from rareflow.spec import FeatureSpec

__all__ = ["FeatureSpec", "functions", "operators", "plans", "runs", "session", "sources", "streaming"]
__version__ = "0.1.0"


def __getattr__(name):  # lazy submodule access: ``import rareflow; rareflow.runs``
    if name in __all__:
        import importlib

        return importlib.import_module(f"rareflow.{name}")
    raise AttributeError(name)
