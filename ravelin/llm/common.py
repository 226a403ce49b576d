"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.runtime import cut, ready, table, written  # noqa: F401

#: Unicode White_Space, the meaning of \s in the tokenizers' patterns (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def by_row(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[tuple], Iterable[tuple]]]) -> DataFrame:
    """Run a generator over the rows of ``columns``, an Arrow batch at a time.

    ``make`` runs once in each task and returns the function of one row, so what it loads or remembers is shared
    by the rows of a task. The output types come from ``schema``.
    """
    ready(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [out for row in zip(*(c.to_pylist() for c in part.columns)) for out in one(row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    return df.select(*columns).mapInArrow(run, schema)


_kept: dict[tuple, object] = {}


def shared(kind: str, key, make: Callable):
    """What ``make`` returns for ``kind`` and ``key``, made once in each Python worker and kept from task to task: the last one only."""
    if (kind, key) not in _kept:
        _kept.clear()
        _kept[kind, key] = make()
    return _kept[kind, key]


def crc_bucket(column: str, n: int):
    """crc32 of an id written in decimal, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


class Memo(dict):
    """Answers of a function of a string, kept for short strings; it starts anew when full, which changes no result."""

    def __init__(self, most: int, answer: Callable | None = None):
        super().__init__()
        self.most, self.answer = most, answer

    def __missing__(self, key: str):
        got = self.answer(key)
        if len(key) < 100:
            self[key] = got
        return got

    def room(self) -> None:
        if len(self) > self.most:
            self.clear()
