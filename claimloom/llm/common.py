"""Pieces the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import multiprocessing
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but the ASCII blanks.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """The words of a text; only ASCII blanks separate (``str.split()`` alone would also split at other blanks)."""
    if not text:
        return []
    # splitting bytes knows the ASCII blanks only
    parts = text.encode("utf-8", "surrogatepass").split()
    return b" ".join(parts).decode("utf-8", "surrogatepass").split(" ") if parts else []


UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_word_bytes(text: str | None) -> list[bytes]:
    """The words in UTF-8 with A-Z lowered; splitting bytes knows the ASCII blanks only."""
    return text.encode("utf-8", "surrogatepass").translate(UPPER).split() if text else []



def lower_ascii(text: str) -> str:
    """A-Z only; other letters keep their case."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(UPPER).decode("utf-8", "surrogatepass")


def give_back() -> None:
    """Free pages of this worker go back to the system; without it they stay with every idle worker of an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: list = [None, None]


def kept_by_worker(name, make):
    """What an operator remembers between the tasks of a worker process.

    Workers serve one operator after the other; asking under another name drops what was kept before, so that their memory
    does not add up.
    """
    if _KEPT[0] != name:
        forget()
        _KEPT[:] = [name, make()]
    return _KEPT[1]


def forget() -> None:
    """Drops what this worker remembers."""
    _KEPT[:] = [None, None]
    gc.collect()
    give_back()


def apart(fn):
    """The result of ``fn`` from a child process, whose memory goes back to the system with it; workers live on after a task.

    What the worker remembers of earlier operators goes first, or it would lie beside the child's own memory.
    """
    forget()
    fork = multiprocessing.get_context("fork")
    receive, send = fork.Pipe(duplex=False)
    child = fork.Process(target=lambda: send.send_bytes(pickle.dumps(fn())))
    child.start()
    send.close()
    try:
        return pickle.loads(receive.recv_bytes())
    finally:
        child.join()


def fold(id_col: str, residue: int, modulus: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``residue``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == residue, F.lit(False))


def arrow_map(df: DataFrame, fn, schema: str, rows: int | None = None) -> DataFrame:
    """``fn`` takes one record batch as a dict of Python lists and yields dicts of columns of the schema.

    ``rows`` cuts batches further, where Python objects of a whole batch of texts would take too much memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    names = wanted.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(wanted)
        cut = batches if rows is None else (b.slice(at, rows) for b in batches for at in range(0, len(b), rows))
        for result in fn({k: b.column(i).to_pylist() for i, k in enumerate(b.schema.names)} for b in cut):
            yield pa.RecordBatch.from_arrays([pa.array(result[n], type=out.field(n).type) for n in names], schema=out)
        give_back()

    return df.mapInArrow(run, wanted)
