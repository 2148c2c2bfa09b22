"""Sinks of files that appear whole or not at all: tasks write to a staging folder, the commit moves files to their places.

A task that is tried again, or runs twice, leaves files in the staging folder that no message names; the commit moves the named
ones and drops the folder, an abort only drops it. A file comes from one task, as a stream: rows that describe it (``kind`` 0)
come before those with its bytes (``kind`` 1), in the order of the file, so a task holds a file's index but never its content.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from .. import storage


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: ``(name, staged path)``."""

    files: list


class StagedWriter(DataSourceWriter):
    """A sink of files under ``path``; a format says in ``parts`` which files its rows make. ``overwrite`` replaces what lies there, else there must be nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.stage = path.rstrip("/"), overwrite, f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
        if not overwrite and self._there():
            raise FileExistsError(f"{path} holds files")

    def parts(self, rows: Iterator) -> Iterator[tuple[str, Iterator[bytes]]]:
        """``(name, chunks)`` for each file of these rows; the chunks are used up before the next file is asked for."""
        raise NotImplementedError

    def _there(self) -> list[str]:
        where, root = storage.filesystem(self.path)
        return storage.files(self.path) if where.get_file_info(root).type.name != "NotFound" else []

    def write(self, iterator: Iterator) -> Staged:
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        where, root = storage.filesystem(self.stage)
        done = []
        for name, chunks in self.parts(iterator):
            where.create_dir(root, recursive=True)
            staged = f"{root}/{attempt}-{name}"
            with where.open_output_stream(staged) as out:
                for chunk in chunks:
                    out.write(chunk)
            done.append((name, staged))
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for n, _ in files]
        if len(set(names)) < len(names):
            self._drop()
            raise ValueError("several tasks made one file: deal its rows to one partition, in order")
        where, root = storage.filesystem(self.path)
        where.create_dir(root, recursive=True)
        for name, staged in files:
            where.move(staged, f"{root}/{name}")
        if self.overwrite:
            kept = set(names)
            for old in self._there():
                if "/_staging-" not in old and old.rsplit("/", 1)[1] not in kept:
                    where.delete_file(storage.filesystem(old)[1])
        self._drop()

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        where, root = storage.filesystem(self.stage)
        if where.get_file_info(root).type.name != "NotFound":
            where.delete_dir(root)


def indexed(payloads: DataFrame, file: str, order: list[str], entry: list[str], payload: str = "payload") -> DataFrame:
    """Rows for a ``StagedWriter``: each file's index rows, then its payloads, in ``order``; one partition holds whole files. Only ``entry`` columns are in index rows."""
    index = payloads.select(file, F.lit(0).alias("kind"), *order, *entry, F.lit(None).cast("binary").alias(payload))
    body = payloads.select(file, F.lit(1).alias("kind"), *order, *(F.lit(None).cast(payloads.schema[c].dataType).alias(c) for c in entry), payload)
    return index.unionByName(body).repartition(file).sortWithinPartitions(file, "kind", *order)
