"""Files that tasks read and write themselves, in any store that pyarrow knows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import TaskContext


def store_of(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def opened(uri: str):
    """A file to read from any place."""
    store, path = store_of(uri)
    return store.open_input_file(path)


@contextmanager
def saved(uri: str) -> Iterator:
    """A stream to a file that takes its name once it is whole; a task that runs again replaces its own file."""
    store, path = store_of(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    task = TaskContext.get()
    half = f"{path}.{task.taskAttemptId() if task else 0}.half"
    with store.open_output_stream(half) as out:
        yield out
    store.move(half, path)
