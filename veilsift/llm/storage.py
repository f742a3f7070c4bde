"""Files that tasks write to and read from the shared folder themselves, by pyarrow's file systems."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from veilsift.shared import shared_path


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, as a URI with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, name))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toString()
    fs, inner = opened(uri)
    fs.create_dir(inner, recursive=True)
    return uri


def own_name(folder: str, part: int, suffix: str) -> str:
    """A name that no other attempt of the same task uses; only what the attempt that succeeds returns is read."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"
