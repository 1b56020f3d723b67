"""Column functions in Python that hold a bounded part of an Arrow batch as Python objects at a time.

A batch has up to ten thousand rows, whatever their length; as pandas objects, with what is found in them, such a batch of texts
takes many times its size. What a batch of the arguments here takes beside its buffers is that of one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a slice's arguments, unless one row has more.
SLICE = 500_000


def _sizes(x: pa.Array) -> np.ndarray:
    if pa.types.is_string(x.type) or pa.types.is_large_string(x.type):
        found = pc.binary_length(x)
    elif pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
        found = pc.multiply(pc.list_value_length(x), 64)
    else:
        return np.full(len(x), 8)
    return pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(columns: tuple[pa.Array, ...], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows whose arguments have ``size`` bytes together, or one row."""
    ends = np.cumsum(sum(_sizes(x) for x in columns) + 16)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, to
        at = to


def over_slices(f: Callable[..., list], kind: str | pa.DataType) -> Callable[..., Column]:
    """A column function of type ``kind`` from ``f``, which takes lists of the arguments of some rows and gives a list of their results."""

    def made(*args: Column | str) -> Column:
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_string

        out = to_arrow_type(_parse_datatype_string(kind))

        def sliced(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
            for at, to in slices(columns):
                yield pa.array(f(*[x.slice(at, to - at).to_pylist() for x in columns]), out)
            if not len(columns[0]):
                yield pa.array([], out)

        def over_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from sliced((batch,))

        def over_several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from sliced(batch)

        return F.arrow_udf(over_one if len(args) == 1 else over_several, kind)(*args)

    return made
