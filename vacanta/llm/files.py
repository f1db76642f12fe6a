"""Files of the shared folder, opened from the driver or from tasks by any address the cluster uses."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from vacanta.session import checkpoint_dir


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that driver and executors share."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/vacanta-{kind}-{uuid.uuid4().hex}"
    return folder


def open_file(address: str, mode: str):
    """A binary file (`rb` or `wb`); parents are made when writing. Local paths, file:// and what pyarrow can reach."""
    parsed = urlparse(address)
    if parsed.scheme in ("", "file"):
        path = parsed.path if parsed.scheme else address
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address)
    if mode == "wb":
        system.create_dir(os.path.dirname(path), recursive=True)
        return system.open_output_stream(path)
    return system.open_input_stream(path)
