"""Files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from colweave.session import shared_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """The URI of a fresh folder under the shared folder."""
    return f"{shared_folder(spark)}/colweave/{kind}-{uuid.uuid4().hex}"


def attempt_name(stem: str, suffix: str) -> str:
    """A file name of this attempt alone: a task that runs twice leaves two files, and only
    the one named in the rows of the attempt that counted is ever read."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def open_output(folder: str, name: str):
    """``(stream, uri)`` for a new file; the scheme of ``folder`` picks the file system."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def open_input(uri: str):
    """A random-access file."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
