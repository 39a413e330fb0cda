"""Named queries over the driver tables, each with equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from importlib import import_module

from parlance.plans.registry import ORACLES, QUERIES

for _name in ("scans", "joins", "aggregates", "windows", "scalars", "planning", "streams", "kernels", "spectra", "random", "selection", "files"):
    import_module(f"parlance.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
