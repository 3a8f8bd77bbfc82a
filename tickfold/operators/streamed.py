"""State that runs along a symbol's rows, in memory of the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed(rows: DataFrame, order: list[str], columns: list[str], start: Callable[[], Callable[..., tuple]], adds: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``adds`` (name -> double, bigint or int). Each symbol's rows stream through a task in
    order, and only the state is kept: ``start`` gives a symbol's step, which takes a row's ``columns`` and returns
    the values to add."""
    names = rows.columns
    kinds = [{"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}[t] for t in adds.values()]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, step = object(), None
        for batch in batches:
            at = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in columns or n == "symbol"}
            found = []
            for own, *values in zip(at["symbol"], *(at[c] for c in columns)):
                if own != symbol:
                    symbol, step = own, start()
                found.append(step(*values))
            added = (pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *adds])

    shape = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [f"`{n}` {t}" for n, t in adds.items()])
    # By a hash of the symbol: a repartition by the symbol itself is dropped where a join by symbol stands before it, and
    # the adaptive planner may turn that into a broadcast join whose tasks read parts of symbols.
    return rows.repartition(F.xxhash64("symbol")).sortWithinPartitions("symbol", *order).mapInArrow(kernel, shape)
