"""One struct column computed from a text column in Arrow batches; the shape all text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS = 256  # rows whose texts are held as Python objects at a time


def give_back() -> None:
    """Hands memory that earlier tasks of this worker have freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def with_struct(
    df: DataFrame,
    text: str,
    out: str,
    fields: T.StructType,
    make: Callable[[], Callable[[list[bytes | None]], list[dict]]],
    keep: Sequence[str] | None = None,
    least_bytes: int = 0,
) -> DataFrame:
    """``keep`` columns (all by default) and the struct column ``out`` computed from ``text``.

    ``make`` runs once per task and returns a function from UTF-8 texts (or None) to one dict per
    text. It is given texts of ``least_bytes`` together or more where a task has them, for functions with a price per
    call. A column that is already called ``out`` is replaced.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != out]
    kept = [df.schema[c] for c in names]
    schema = T.StructType([*kept, T.StructField(out, fields)])
    kind = to_arrow_type(fields)
    source = df.select(*[_quote(c) for c in dict.fromkeys([*names, text])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        fn = make()
        held: list[pa.RecordBatch] = []
        texts: list[bytes | None] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            made = fn(texts)
            at = 0
            for part in held:
                column = pa.array(made[at : at + part.num_rows], type=kind)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], column], names=[*names, out])
            held.clear()
            texts.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                more = part.column(text).cast(pa.binary()).to_pylist()
                held.append(part)
                texts.extend(more)
                size += sum(map(len, filter(None, more)))
                if size >= least_bytes:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return source.mapInArrow(run, schema)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` has; letter case does not count."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
