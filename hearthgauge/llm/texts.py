"""Python functions of whole texts as Arrow batches, beside columns that pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts taken from a batch at a time, which bounds what their results hold.
AT_A_TIME = 500


def map_texts(docs: DataFrame, keep: list, text: Column, start: Callable[[], Callable[[list], Iterable[tuple]]], made: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """`docs` with the columns `keep`, and those of `made` (a schema) for each text.

    start() gives, once a task, a function from texts to one tuple a text. Columns kept stay in Arrow, so integers
    beside nulls, and any other type, keep their values.
    """
    source = docs.select(*keep, text.alias("__text"))
    new = StructType.fromDDL(made)
    schema = StructType([*source.schema.fields[:-1], *new.fields])
    arrow, names = to_arrow_schema(new), schema.names

    def run(batches):
        of = start()
        for batch in batches:
            for k in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(k, AT_A_TIME)
                *kept, texts = part.columns
                values = [*zip(*of(texts.to_pylist()), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, f.type) for v, f in zip(values, arrow, strict=True))], names=names)
        if finish is not None:
            finish()

    return source.mapInArrow(run, schema)
