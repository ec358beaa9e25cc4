"""``df.write.format("documents")``: documents as files that are there as a whole or not at all, with version numbers given in the commit.

    register(spark)
    df.write.format("documents").option("kind", "IRL").option("suffix", "xlsx").mode("append").save(folder)

``df`` has (name, content: binary or string). Tasks write under names that no reader looks for, and tell the driver which; only the commit of
the whole job gives each document the version after its last and moves it to ``<name>_<kind>_v<version>.<suffix>``. A task that fails or is
repeated leaves nothing behind but such a file, which the next commit or abort deletes. The numbers are kept in ``version_tracker.json`` of the
folder, which ``tracker`` reads. One job writes to a folder at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ledgerlens.errors import ConfigurationError, ProcessingError

TRACKER, PENDING = "version_tracker.json", "_pending"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if {"name", "content"} - set(schema.names):
            raise ProcessingError("documents have a name and a content")
        return DocumentWriter(dict(self.options), overwrite)


@dataclass
class Written(WriterCommitMessage):
    """The documents of a task: (name, place) of each."""

    documents: list


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if not options.get("path"):
            raise ConfigurationError("no path")
        if overwrite:
            raise ConfigurationError("documents are only added, as new versions")
        self.path, self.kind, self.suffix, self.job = options["path"], options.get("kind", "DOC"), options.get("suffix", "txt"), uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, top = _system(self.path)
        pending = f"{top}/{PENDING}/{self.job}"
        system.create_dir(pending, recursive=True)
        done = []
        for row in iterator:
            if row["name"] is None or re.search(r"[/\\]", row["name"]):
                raise ProcessingError(f"no name for a file: {row['name']}")
            place = f"{pending}/{uuid.uuid4().hex}"
            content = row["content"]
            with system.open_output_stream(place) as out:
                out.write(content.encode() if isinstance(content, str) else content or b"")
            done.append((row["name"], place))
        return Written(done)

    def commit(self, messages) -> None:
        """Documents of one name get numbers in the order of their contents' places in the messages."""
        from pyarrow import fs

        system, top = _system(self.path)
        documents = [d for m in messages if m is not None for d in m.documents]
        system.create_dir(top, recursive=True)
        versions = _versions(system, top)
        ending = re.compile(rf"(.*)_{re.escape(self.kind)}_v(\d+)\.{re.escape(self.suffix)}$")
        for x in system.get_file_info(fs.FileSelector(top)):
            # a file that a lost tracker does not know keeps its number
            if found := ending.match(x.base_name):
                versions[found[1]] = max(versions.get(found[1], 0), int(found[2]))
        for name, place in documents:
            versions[name] = versions.get(name, 0) + 1
            system.move(place, f"{top}/{name}_{self.kind}_v{versions[name]}.{self.suffix}")
        fresh = f"{top}/{PENDING}-{self.job}.json"
        with system.open_output_stream(fresh) as out:
            out.write(json.dumps(versions, indent=2, sort_keys=True).encode())
        system.move(fresh, f"{top}/{TRACKER}")
        self._clear(system, top)

    def abort(self, messages) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, top: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{top}/{PENDING}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{PENDING}")


def _versions(system, top: str) -> dict[str, int]:
    """The tracker's numbers; a missing or broken one counts as empty."""
    try:
        with system.open_input_stream(f"{top}/{TRACKER}") as f:
            found = json.loads(f.read())
        return {k: v for k, v in found.items() if isinstance(v, int)}
    except (FileNotFoundError, ValueError, AttributeError):
        return {}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)


def save(df: DataFrame, path: str, kind: str, suffix: str = "txt") -> None:
    """Adds (name, content) documents to a folder as their next versions."""
    register(df.sparkSession)
    df.write.format("documents").options(kind=kind, suffix=suffix).mode("append").save(path)


def tracker(spark: SparkSession, path: str) -> DataFrame:
    """(name, version) of a folder's documents, as they are stored; none for a new folder."""
    from ledgerlens.sources import texts

    stored = spark.read.format("binaryFile").option("pathGlobFilter", TRACKER).load(path)
    return texts.tracked_versions(stored.selectExpr("decode(content, 'UTF-8') AS json"), "json")
