"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

#: The bytes of ``[\x20\x09-\x0D]`` that every contract here takes as white space.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_resident: list = []


def resident(build: Callable[..., Any], *args: Any) -> Any:
    """What ``build(*args)`` gives, kept by a worker until it needs another model.

    Workers serve one operator after the other; each holds one model at a time.
    """
    if not _resident or _resident[0] != (build, args):
        forget()
        _resident[:] = [(build, args), build(*args)]
    return _resident[1]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns freed memory to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def _give_back() -> None:
    if trim := _trim():
        trim(0)


def forget() -> None:
    """Give up the model that this worker holds, and the memory that Arrow and the C library keep."""
    if _resident:
        _resident.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    _give_back()


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls into the fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def with_column(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns set or replaced."""
    arrays = dict(zip(batch.schema.names, batch.columns)) | columns
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def schema_with(df: DataFrame, *fields: str, drop: tuple[str, ...] = ()) -> str:
    """DDL of the frame's columns followed by ``name type`` fields, which replace columns of the same name."""
    new = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in fields}
    old = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in drop}
    return ", ".join(f"`{k}` {v}" for k, v in (old | new).items())


#: A character beyond Latin-1; below it, all Unicode versions in use agree on letters and numbers.
BEYOND_LATIN1 = re.compile("[^\x00-\xff]")


@lru_cache(maxsize=8)
def latin1_pattern(pattern: str) -> re.Pattern:
    """A pattern with ``\\p{L}``, ``\\p{N}`` and ``\\s`` for the standard library, right for Latin-1 texts."""
    of = lambda test: "".join(f"\\x{c:02x}" for c in range(256) if test(chr(c)))
    classes = {
        r"\p{L}": of(lambda c: unicodedata.category(c)[0] == "L"),
        r"\p{N}": of(lambda c: unicodedata.category(c)[0] == "N"),
        r"\s": of(lambda c: c in "\t\n\v\f\r \x85\xa0"),
    }
    classes[r"\S"] = "^" + classes[r"\s"]
    out, inside = [], False
    for token in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        if token in classes:
            token = classes[token] if inside else f"[{classes[token]}]"
        elif token in "[]":
            inside = token == "["
        out.append(token)
    return re.compile("".join(out))
