"""Arrow batches handled slice by slice, so that a task holds the Python objects of few files at a time."""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Files, and bytes of their texts, whose results stand in Python at once.
SLICE_ROWS = 1_000
SLICE_BYTES = 1 << 20


@contextmanager
def _no_cycle_search() -> Iterator[None]:
    """Parsers make trees of many objects that counting references frees; searching them for cycles costs as much again."""
    searching = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if searching:
            gc.enable()


def by_slices(convert: Callable[..., pa.Array], texts: pa.Array, *others: pa.Array) -> pa.Array:
    """``convert`` of slices of the arrays, joined; it must treat each row by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    found, first, held = [], 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > first and (at - first >= SLICE_ROWS or held + size > SLICE_BYTES):
            with _no_cycle_search():
                found.append(convert(*(a.slice(first, at - first) for a in (texts, *others))))
            first, held = at, 0
        held += size
    with _no_cycle_search():
        found.append(convert(*(a.slice(first) for a in (texts, *others))))
    return found[0] if len(found) == 1 else pa.concat_arrays(found)


def written(names: Column, there: Column) -> Column:
    """An array of names as one text to hand to Python, null unless ``there``. Spark sums up the size of a batch for every
    row that it adds, which for a column of arrays takes as long as the batch has rows."""
    return F.when(there, F.to_json(names))


def read_back(names: pa.Array) -> list[list[str | None] | None]:
    return [None if n is None else json.loads(n) for n in names.to_pylist()]
