"""Rows of Arrow batches with columns that a function of each row makes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import pyarrow as pa

#: Bytes or items made after which a batch is handed on.
MOST = 1 << 24


def made_rows(batches: Iterator[pa.RecordBatch], given: list[str], make: Callable[..., tuple], made: dict[str, pa.DataType], left: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``left`` as they come, and those of ``made``: ``make`` of the row's scalars in ``given``.

    A batch with large results is handed on in parts, so memory is bounded by ``MOST`` and the largest row.
    """
    import pyarrow as pa

    for batch in batches:
        columns, rows, start, weight = [batch.column(c) for c in given], [], 0, 0
        for at in range(batch.num_rows):
            rows.append(make(*(c[at] for c in columns)))
            weight += sum(len(v) for v in rows[-1] if hasattr(v, "__len__"))
            if weight >= MOST or at == batch.num_rows - 1:
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), made.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(rows)) for c in left), *arrays], names=[*left, *made])
                rows, start, weight = [], at + 1, 0
