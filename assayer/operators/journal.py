"""A journal of answers: what a model says is kept as it comes, so that a run that dies pays for nothing twice.

Each answer is a small file of its own, named by a hash of the unit, its inputs and the messages, and moved into place as soon
as the answer is there. Before a call a task looks for its file, so neither a task that is tried again nor a later run makes a call that was
answered, however rows are dealt out by then. One look costs little beside a call, and no task reads what others wrote.

The folder must be one that Arrow's file systems can write from tasks: local or mounted disks, HDFS with its native
library, and object stores.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.published import file_system


@dataclass(frozen=True)
class Journal:
    """``keys``: columns that name a unit and its inputs."""

    path: str
    keys: tuple[str, ...] = ()

    def call(self, slot: str, messages: Column) -> Column:
        """What a call is known by; ``slot`` tells calls of one unit apart that have the same messages."""
        return F.sha2(F.to_json(F.struct(F.lit(slot).alias("slot"), messages.alias("messages"), *(F.col(k) for k in self.keys)), {"ignoreNullFields": "false"}), 256)

    def answers(self, spark: SparkSession) -> DataFrame:
        """(call, response) of all that is kept."""
        kind = "call string, response string"
        fs, at = file_system(spark, self.path)
        if not fs.exists(at):
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).option("recursiveFileLookup", True).json(self.path)

    def clear(self, spark: SparkSession) -> None:
        fs, at = file_system(spark, self.path)
        fs.delete(at, True)

    def open(self) -> Answers:
        """For a task."""
        return Answers(self.path)


class Answers:
    def __init__(self, path: str):
        from pyarrow import fs

        self._fs, self._root = fs.FileSystem.from_uri(path)
        self._missing = fs.FileType.NotFound

    def _at(self, call: str) -> str:
        return f"{self._root}/{call[:2]}/{call}.json"

    def get(self, call: str) -> str | None:
        if self._fs.get_file_info(self._at(call)).type == self._missing:
            return None
        with self._fs.open_input_stream(self._at(call)) as f:
            return json.loads(f.read())["response"]

    def add(self, call: str, response: str) -> None:
        """The file is moved into place, so that no reader sees a part of it."""
        folder = f"{self._root}/{call[:2]}"
        part = f"{folder}/.{uuid.uuid4().hex}"
        self._fs.create_dir(folder, recursive=True)
        with self._fs.open_output_stream(part) as f:
            f.write((json.dumps({"call": call, "response": response}) + "\n").encode())
        self._fs.move(part, self._at(call))
