"""Python data sources: registry indexes as a table, and a telemetry log as a streaming sink.

    spark.dataSource.register(RegistrySource); spark.read.format("registry").load(folder)
    spark.dataSource.register(TelemetrySink); events.writeStream.format("telemetry").option("path", folder).start()

Paths are URIs or absolute paths that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

REGISTRY_VERSION = "1.0"
# The envelope of an event, and the types that are taken.
SCHEMA_VERSION = "1.1"
ENVELOPE = ["schema_version", "event_id", "event_type", "ts", "project_hash", "payload"]
EVENT_TYPES = ["phase_start", "phase_complete", "validator_verdict", "divergence_filed", "divergence_resolved", "escalation_fired", "party_session", "error_class", "compression_run"]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class RegistrySource(DataSource):
    """Entries of JSON indexes {"registry_version": ..., "entries": [...]}: a task for each file. An index that isn't JSON or of another version is an error, unless `lenient` is true."""

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "file string, name string, version string, maintainer string, description string, tags array<string>"

    def reader(self, schema) -> DataSourceReader:
        return RegistryReader(self.options)


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.version, self.lenient = options["path"], options.get("registryVersion", REGISTRY_VERSION), str(options.get("lenient", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, inner = _open(self.path)
        info = store.get_file_info(inner)
        files = [inner] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.endswith(".json"))
        return [InputPartition(f) for f in files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        store, _ = _open(self.path)
        with store.open_input_stream(partition.value) as f:
            raw = f.read()
        try:
            data = json.loads(raw)
            if not isinstance(data, dict) or data.get("registry_version") != self.version:
                raise ValueError(f"registry_version is not {self.version}")
        except ValueError as e:
            if self.lenient:
                return
            raise ValueError(f"{partition.value}: {e}") from e
        for e in data.get("entries") or []:
            text = lambda key, e=e: None if e.get(key) is None else str(e[key])
            yield partition.value, text("name"), text("version"), text("maintainer"), text("description"), [str(t) for t in e.get("tags") or []]


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    events: int
    rejected: int


class TelemetrySink(DataSource):
    """Rows (event_id, event_type, ts, project_hash, payload) as JSON lines with the six keys of an envelope. Other event types are left out and counted."""

    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802 (a name that Spark asks for)
        missing = {"event_type", "ts"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"events without {sorted(missing)}")
        return TelemetryWriter(self.options["path"])


class TelemetryWriter(DataSourceStreamWriter):
    """Tasks write files aside; a batch that is committed moves its own into the log under its number, one that is aborted removes them. A batch that comes again after its commit changes nothing."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        lines, rejected = [], 0
        for r in iterator:
            row = r.asDict(recursive=True)
            if row.get("event_type") not in EVENT_TYPES:
                rejected += 1
                continue
            payload = row.get("payload")
            if isinstance(payload, str):
                try:
                    payload = json.loads(payload)
                except ValueError:
                    payload = {"text": payload}
            event = {"schema_version": SCHEMA_VERSION, "event_id": row.get("event_id") or str(uuid.uuid4()), "event_type": row["event_type"], "ts": row["ts"].isoformat() if hasattr(row["ts"], "isoformat") else row["ts"], "project_hash": row.get("project_hash") or "0" * 16, "payload": payload or {}}
            lines.append(json.dumps({k: event[k] for k in ENVELOPE}, default=str, ensure_ascii=False))
        if not lines:
            return Written(None, 0, rejected)
        store, inner = _open(self.path)
        store.create_dir(f"{inner}/_pending")
        name = f"{inner}/_pending/{uuid.uuid4().hex}.jsonl"
        with store.open_output_stream(name) as out:
            out.write(("\n".join(lines) + "\n").encode())
        return Written(name, len(lines), rejected)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803 (a name that Spark asks for)
        from pyarrow import fs

        store, inner = _open(self.path)
        store.create_dir(f"{inner}/_commits")
        mark = f"{inner}/_commits/{batchId:010d}.json"
        again = store.get_file_info(mark).type == fs.FileType.File
        some = [m for m in messages if m is not None]
        for i, m in enumerate(m for m in some if m.file):
            if again:
                store.delete_file(m.file)
            else:
                store.move(m.file, f"{inner}/batch-{batchId:010d}-{i:05d}.jsonl")
        if not again:
            with store.open_output_stream(mark) as out:
                out.write(json.dumps({"batch": batchId, "events": sum(m.events for m in some), "rejected": sum(m.rejected for m in some)}).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, _ = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(m.file)
