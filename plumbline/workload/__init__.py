"""Every operator as a query over the test tables, with equivalent SQL."""

from plumbline.workload import (  # noqa: F401
    charting,
    cleaning,
    core,
    evidencing,
    guards,
    profiling,
    texting,
)
from plumbline.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
