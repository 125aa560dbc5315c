"""Hooks for external models: OCR, span and entity recognisers, vision models, judges.

No model runs here. A hook gets a factory that builds the model once per Python
worker and a function from (model, row values) to result rows; tables of earlier
results take the same place in a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

_loaded: dict[str, Any] = {}


def model(name: str, factory: Callable[[], Any]) -> Any:
    """This worker's model ``name``."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def call(rows: DataFrame, name: str, factory: Callable[[], Any], apply: Callable[[Any, dict], Iterable[tuple]], schema: str, tries: int = 3) -> DataFrame:
    """``apply(model, row)`` for every row, and ``error``: null, or why the row's last try failed.

    A row whose tries all fail gives one row with its own values in the columns it shares with ``schema`` and nulls in the others.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(name, factory)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                why = ""
                for _ in range(tries):
                    try:
                        out += [(*r, None) for r in apply(m, row)]
                        break
                    except Exception as e:
                        why = f"{type(e).__name__}: {e}"
                else:
                    out.append((*(row.get(c) for c in names), why))
            yield pd.DataFrame(out, columns=[*names, "error"])

    return rows.mapInPandas(run, schema + ", error string")


def images(spark: Any, path: str) -> DataFrame:
    """Image files as (path, content) rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path).select("path", "content")
