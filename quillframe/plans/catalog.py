"""Every query of the library by name, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The query that the smoke check runs.
FLAGSHIP = "decode_accuracy"

#: Modules with QUERIES: dict of name -> (function of (spark, sf_dir), SQL or None).
MODULES = (
    "quillframe.operators.lexicon",
    "quillframe.operators.models",
    "quillframe.operators.components",
    "quillframe.operators.matching",
    "quillframe.operators.evaluate",
    "quillframe.operators.vectors",
    "quillframe.operators.gaps",
    "quillframe.operators.ranking",
    "quillframe.operators.raster",
    "quillframe.operators.decode",
    "quillframe.operators.reports",
    "quillframe.operators.refine",
    "quillframe.operators.chains",
    "quillframe.operators.agglomerate",
    "quillframe.operators.pages",
    "quillframe.operators.splits",
)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    import importlib

    out: dict = {}
    for m in MODULES:
        for name, q in importlib.import_module(m).QUERIES.items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = q
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
