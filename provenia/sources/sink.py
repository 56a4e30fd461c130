"""A sink for results: each task writes its part of JSON arrays, the commit joins them by a manifest that also counts verdicts."""

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from provenia.operators.stages import workers_find_package

NAME, MANIFEST = "provenia_results", "manifest.json"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int
    verdicts: dict[str, int] = field(default_factory=dict)


class ResultWriter(DataSourceWriter):
    """Writes rows (result, outcome): a part is a JSON array of the results of one task, written under a name of the attempt's own.

    Only what the manifest names counts. It is written last, by the driver, in one file: of a job that fails nothing is named, of a task that is tried
    again the attempt that was committed. Parts of other attempts are deleted; one that a task writes after its job was given up stays, unnamed, until
    a job commits to the folder. The driver gets one small message for each task.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        files, root = opened(self.path)
        context = TaskContext.get()
        name, n, verdicts = f"part-{context.partitionId():05d}-{self.job}-{context.taskAttemptId()}.json", 0, Counter()
        out = None
        try:
            for row in rows:
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}")
                json.loads(row["result"])  # what is no JSON must not make a part unreadable
                out.write((b"[" if n == 0 else b",") + b"\n" + row["result"].encode())
                n += 1
                verdicts[row["outcome"]] += 1
            if out is not None:
                out.write(b"\n]\n")
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{root}/{name}")
            raise
        return Part(name if n else None, n, dict(verdicts))

    def commit(self, messages: list[Part]) -> None:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.name)
        verdicts = sum((Counter(m.verdicts) for m in parts), Counter())
        told = {"parts": [{"name": m.name, "results": m.rows} for m in parts], "results": sum(m.rows for m in parts), "verdicts": dict(sorted(verdicts.items()))}
        with files.open_output_stream(f"{root}/{MANIFEST}.{self.job}") as f:
            f.write(json.dumps(told, indent=2).encode())
        files.move(f"{root}/{MANIFEST}.{self.job}", f"{root}/{MANIFEST}")
        self._clear({MANIFEST, *(m.name for m in parts)}, "")

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(set(), self.job)

    def _clear(self, keep: set[str], of: str) -> None:
        """Deletes the parts in the folder but those to keep; of a job: its parts alone."""
        files, root = opened(self.path)
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("part-") and of in info.base_name and info.base_name not in keep:
                files.delete_file(info.path)


def _need_new(folder: str) -> None:
    files, root = opened(folder)
    if files.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
        raise ValueError(f"{folder} has results already")


class ResultSource(DataSource):
    """df.write.format("provenia_results").mode("append").save(folder) for rows (result, outcome)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "result string, outcome string"

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        if overwrite or not {"result", "outcome"} <= set(schema.names):
            raise ValueError("rows of result and outcome are appended to a folder of their own")
        _need_new(self.options["path"])
        return ResultWriter(self.options["path"])


def save_results(results: DataFrame, folder: str) -> dict:
    """Writes results(result, outcome) to a folder in one run and returns its manifest: parts, number of results, verdicts."""
    _need_new(folder)
    workers_find_package(results.sparkSession)
    results.sparkSession.dataSource.register(ResultSource)
    results.select("result", "outcome").write.format(NAME).mode("append").save(folder)
    return manifest(folder)


def manifest(folder: str) -> dict:
    files, root = opened(folder)
    with files.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read().decode())


def saved_results(spark: SparkSession, folder: str) -> DataFrame:
    """The results that the manifest names, one JSON text a row."""
    parts = [f"{folder}/{p['name']}" for p in manifest(folder)["parts"]]
    if not parts:
        return spark.createDataFrame([], "result string")
    return spark.read.text(parts, wholetext=True).selectExpr("explode(cast(parse_json(value) as array<variant>)) AS v").selectExpr("to_json(v) AS result")


def exit_code(told: dict) -> int:
    """Of a manifest: 1 if any instance is rejected, else 0."""
    return int(told["verdicts"].get("reject", 0) > 0)
