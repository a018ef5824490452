"""Arrow helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from propago.session import bound_batches

#: Rows that a worker turns into Python objects at once; bounds its memory, not the result.
ROWS = 256


def append_columns(df: DataFrame, inputs: dict[str, str], fields: list[StructField], make: Callable[[], Callable]) -> DataFrame:
    """Append ``fields`` to ``df``. ``make()`` runs once a task and returns ``fn(*lists) -> arrays``.

    ``inputs`` maps column names to the type they are cast to for ``fn``. All columns of ``df`` pass through, in order,
    but for those named like an output, which the output replaces.
    """
    bound_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    fed = [F.col(f"`{c}`").cast(kind).alias(f"__in{i}") for i, (c, kind) in enumerate(inputs.items())]
    schema = StructType([*(df.schema[c] for c in kept), *fields])
    names, n = [f.name for f in schema], len(kept)

    def run(batches):
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = fn(*(part.column(i).to_pylist() for i in range(n, part.num_columns)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *out], names=names)

    return df.select(*(F.col(f"`{c}`") for c in kept), *fed).mapInArrow(run, schema)


def list_of(arrays: list, kind: pa.DataType) -> pa.ListArray:
    """A list column from one numpy array a row."""
    import numpy as np

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))
