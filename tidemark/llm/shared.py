"""Arrays in a folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession

from ..sources.cluster import ship_package
from .tables import new_folder, written  # noqa: F401


#: Rows and bytes of an Arrow batch of texts: what a Python worker and its executor hold of its input at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Before Python runs in tasks: send the package, and bound Arrow batches (texts are long; 10 000 rows are some 30 MB a copy)."""
    ship_package(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _open(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{os.path.abspath(uri)}"
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as files uri.name; a file appears whole or not at all, and a task that runs twice writes the same."""
    system, path = _open(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    for name, values in arrays.items():
        part = f"{path}.{name}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(np.ascontiguousarray(values).tobytes())
        system.move(part, f"{path}.{name}")


def save_rows(uri: str, name: str, rows) -> None:
    """As save, one array after another into one file: only one is held at a time."""
    system, path = _open(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        for values in rows:
            out.write(np.ascontiguousarray(values).tobytes())
    system.move(part, f"{path}.{name}")


def mapped(uri: str, name: str, kind) -> np.ndarray:
    """An array of save(), memory-mapped; one that is not on a file system of this machine is copied first, to a file without a name."""
    system, path = _open(f"{uri}.{name}")
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{uri}.{name}")
    if not info.size:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with tempfile.TemporaryFile() as local:  # unlinked from the start: nothing stays behind
        with system.open_input_stream(path) as src:
            while block := src.read(1 << 24):
                local.write(block)
        local.flush()
        return np.memmap(local, dtype=kind, mode="r")
