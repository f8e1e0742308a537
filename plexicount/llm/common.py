"""What the operators of this subpackage share: table access, staged tables, worker caches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable
from functools import wraps
from urllib.parse import urlparse
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, fresh_dir, shared_dir, staged

__all__ = ["LOWER", "NON_WORD", "UPPER", "WS", "ascii_lower", "discard", "filesystem", "fresh_dir", "give_back", "gives_back", "read_whole", "row_of", "shared_dir", "staged", "table", "worker_cache", "write_whole"]

#: ASCII white space, the only separator of words in most contracts.
WS = r"[\x20\x09-\x0D]+"
#: What separates words made of ASCII letters, digits and everything beyond ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns can't clash with the caller's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct(F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would change other letters as well."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def filesystem(path: str):
    """The file system of a path of the shared folder, and the path in it."""
    import pyarrow.fs as pafs

    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        return pafs.LocalFileSystem(), uri.path
    return pafs.FileSystem.from_uri(path)


def write_whole(path: str, chunks: Iterable[bytes]) -> None:
    """A file of the shared folder that appears whole or not at all, however often its task runs."""
    fs, place = filesystem(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(temporary := f"{place}.{uuid4().hex}") as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(temporary, place)


def read_whole(path: str) -> bytes:
    fs, place = filesystem(path)
    with fs.open_input_file(place) as f:
        return f.read()


def worker_cache(name: str) -> dict:
    """A dict that lives in the Python worker until another operator asks for its own."""
    held = sys.__dict__.setdefault("_plexicount_worker_caches", {})
    if name not in held:
        held.clear()
    return held.setdefault(name, {})


def give_back() -> None:
    """Memory that is free goes back to the system.  Arrow's pool and the C library keep it else, and an
    executor keeps idle workers for a minute."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def gives_back(task: Callable) -> Callable:
    """For functions of a worker that yield batches: what a task has freed doesn't stay with the idle worker."""

    @wraps(task)
    def run(*args):
        yield from task(*args)
        give_back()

    return run
