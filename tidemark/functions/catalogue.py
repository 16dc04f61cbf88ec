"""What the library offers, as a table."""

from __future__ import annotations

import importlib
import inspect

from pyspark.sql import DataFrame, SparkSession

FAMILIES = {
    "series": "sources.series", "validation": "sources.validate", "generators": "sources.generators", "rolling": "operators.rolling", "regimes": "operators.regime",
    "scaling": "operators.scaling", "states": "operators.discretize", "transitions": "operators.markov", "proximity": "operators.proximity",
    "visibility": "operators.visibility", "hurst": "operators.hurst", "warnings": "operators.warning", "distances": "functions.distances",
}


def entries() -> list[tuple[str, str, str]]:
    """(family, name, first line of its description) of every public function."""
    out = []
    for family, module in FAMILIES.items():
        m = importlib.import_module(f"tidemark.{module}")
        for name, f in sorted(vars(m).items()):
            if inspect.isfunction(f) and not name.startswith("_") and f.__module__ == m.__name__:
                out.append((family, name, (inspect.getdoc(f) or "").split("\n")[0]))
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """(family, name, description) of every public function."""
    return spark.createDataFrame(entries(), "family string, name string, description string")
