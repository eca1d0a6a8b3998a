"""What the operators here share: the library's folders, lineage cuts and code shipping, and slices of batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import dropped, new_path, parts_for, shared_dir, spread, written
from ..session import hadoop as _hadoop
from ..session import ship as shipped

__all__ = ["WORD_PATTERN", "_hadoop", "dropped", "file_system", "new_path", "parts_for", "shared_dir", "shipped", "sliced", "spread", "table", "written"]

#: Words are runs of anything but these six ASCII blanks; ``bytes.split()``
#: splits on exactly the same set.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Bytes of texts that a worker holds as objects at a time, unless one row alone has more.
HELD = 32 << 20


def sliced(batches, rows: int = 256, held: int = HELD):
    """Arrow batches in slices of a few rows and bytes, so that a worker never holds a whole batch of long texts as objects."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        before = np.r_[0, np.cumsum(size)]
        i = 0
        while i < b.num_rows:
            j = min(i + rows, max(i + 1, int(np.searchsorted(before, before[i] + held, "right")) - 1), b.num_rows)
            yield b.slice(i, j - i)
            i = j


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Names under which Hadoop knows a store that the workers' library calls otherwise.
_STORES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(uri: str):
    """(file system, path) for a URI as Hadoop prints it, on any machine.

    ``dbfs:`` is the mount of that name, stores have their library's scheme.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(_STORES.get(scheme, scheme) + ":" + rest)
