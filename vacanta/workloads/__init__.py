from vacanta.workloads import texts, demand, people, runs, streams, composed, feeds, judged, frames  # noqa: F401
from vacanta.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
