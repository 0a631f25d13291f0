"""Rows made from one text at a time, in Arrow batches: what a text's own row decides needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts whose rows make a batch.
TEXTS = 200


def _column(parts: list, kind: pa.DataType) -> pa.Array:
    if not isinstance(parts[0], np.ndarray):
        return pa.array([x for p in parts for x in p], kind)
    if any(isinstance(x, np.ma.MaskedArray) for x in parts):
        whole = np.ma.concatenate(parts)
        return pa.array(whole.data, kind, mask=np.ma.getmaskarray(whole))
    x = np.concatenate(parts)
    if kind != pa.string():
        return pa.array(x, kind, from_pandas=False)
    codes, at = np.unique(x, return_inverse=True)
    return pa.array(list(map(chr, codes.tolist())), kind).take(pa.array(at))


def per_text(docs: DataFrame, key: str, text: str, fields: list[tuple[str, str, pa.DataType]], made: Callable[[str], tuple]) -> DataFrame:
    """key and fields: for each text the columns of its rows (lists or arrays, masked where null; symbols' code points for a string); none for a null text."""
    names = [key, *(n for n, *_ in fields)]

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                found = [(i, own) for i, t in enumerate(b.column(1).to_pylist()) if t is not None and len((own := made(t))[0])]
                if found:
                    rows = np.repeat([i for i, _ in found], [len(own[0]) for _, own in found])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *(_column([own[k] for _, own in found], f[2]) for k, f in enumerate(fields))], names=names)

    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"{n} {t}" for n, t, _ in fields)])
    return docs.select(F.col(key), F.col(text)).mapInArrow(over, schema)
