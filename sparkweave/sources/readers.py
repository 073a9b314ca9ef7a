"""Files and folders as lazy DataFrames; paths are local, or of any store that Spark has a connector for."""

from __future__ import annotations

import re

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from sparkweave.sources import files

#: Options of CSV tables under their SQL names -> Spark's.
_CSV = {"has_header": "header", "delimiter": "sep", "quote": "quote", "escape": "escape", "comment": "comment", "newlines_in_values": "multiLine", "null_value": "nullValue", "date_format": "dateFormat", "timestamp_format": "timestampFormat", "compression": "compression"}


def _fetched(spark: SparkSession, path: str) -> str:
    """An http(s) or ftp file, which Spark's file sources do not read, is fetched to every node first."""
    if re.match(r"(https?|ftp)://", path):
        spark.sparkContext.addFile(path)
        return "file://" + SparkFiles.get(path.rstrip("/").rsplit("/", 1)[-1])
    return path


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_fetched(spark, path))


def stream(spark: SparkSession, kind: str, path: str, schema: str, **options) -> DataFrame:
    """A folder as an unbounded table: files that come later are read later."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def listing(spark: SparkSession, path: str, extension: str = "parquet") -> DataFrame:
    return spark.read.option("pathGlobFilter", f"*{extension}").parquet(path.rstrip("/") + "/")


def csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """With a header and inferred types unless options say otherwise."""
    told = {"header": True, "inferSchema": schema is None} | {_CSV.get(k, k): v for k, v in options.items()}
    reader = spark.read.options(**told)
    return (reader.schema(schema) if schema else reader).csv(_fetched(spark, path))


def json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line."""
    return (spark.read.schema(schema) if schema else spark.read).json(_fetched(spark, path))


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def avro(spark: SparkSession, path: str) -> DataFrame:
    """Needs Spark's external Avro module on the class path."""
    return spark.read.format("avro").load(path)


def arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, a file or a folder: of the file format a task reads a record batch, of the stream format a file.

    The driver reads one schema; executors open the files themselves, so the path is on a store that they share.
    """
    import pyarrow as pa
    from pyspark import cloudpickle
    from pyspark.sql.pandas.types import from_arrow_schema

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # not the contents
    first = listed.first()
    if first is None:
        raise ValueError(f"no files in {path}")
    get = cloudpickle.loads(cloudpickle.dumps(files.opened))

    def reader(address: str):
        store, at = get(address)
        source = store.open_input_file(at)
        is_file = source.read(6) == b"ARROW1"
        source.seek(0)
        return (pa.ipc.open_file if is_file else pa.ipc.open_stream)(source)

    schema = from_arrow_schema(reader(first[0]).schema)

    def count(batches):
        for batch in batches:
            for address in batch.column("path").to_pylist():
                n = getattr(reader(address), "num_record_batches", -1)
                yield pa.RecordBatch.from_pydict({"path": [address] * max(n, 1), "k": list(range(n)) if n > 0 else [min(n, 0)]}, pa.schema([("path", pa.string()), ("k", pa.int32())]))

    def decode(batches):
        for batch in batches:
            for address, k in zip(batch.column("path").to_pylist(), batch.column("k").to_pylist()):
                opened = reader(address)
                if k < 0:
                    yield from opened
                elif opened.num_record_batches:
                    yield opened.get_batch(k)

    parts = listed.mapInArrow(count, "path string, k int")
    return parts.repartition("path", "k").mapInArrow(decode, schema)


def _options(text: str) -> dict[str, str]:
    m = re.search(r"\bOPTIONS\s*\((.*?)\)", text, re.I | re.S)
    pairs = re.findall(r"""['"]?([\w.]+)['"]?\s+(?:=\s*)?['"]?([^'",)]+)['"]?""", m[1]) if m else []
    return {k.split(".")[-1].lower(): v for k, v in pairs}


def external(spark: SparkSession, columns: str | None, rest: str, unbounded: bool = False) -> DataFrame:
    """The table of CREATE EXTERNAL TABLE: column definitions in brackets or none, then STORED AS, LOCATION and options.

    An unbounded one is a stream over a folder; without column definitions it has those of the files that are there.
    """
    kind, at = re.search(r"\bSTORED\s+AS\s+(\w+)", rest, re.I), re.search(r"\bLOCATION\s+'([^']+)'", rest, re.I)
    if not kind or not at:
        raise ValueError("an external table needs STORED AS and LOCATION")
    schema, told = columns[1:-1] if columns else None, _options(rest)
    if unbounded:
        form = {"ndjson": "json"}.get(kind[1].lower(), kind[1].lower())
        if form not in ("parquet", "csv", "json", "orc"):
            raise ValueError(f"no stream of that format: {form}")
        headed = {"header": told.get("has_header", "true" if not schema or re.search(r"\bWITH\s+HEADER\s+ROW\b", rest, re.I) else "false")} if form == "csv" else {}
        there = external(spark, columns, rest).schema
        return stream(spark, form, at[1], there, **headed)
    match kind[1].lower():
        case "parquet":
            return parquet(spark, at[1])
        case "csv":
            if schema and "has_header" not in told and not re.search(r"\bWITH\s+HEADER\s+ROW\b", rest, re.I):
                told["has_header"] = "false"
            return csv(spark, at[1], schema, **{k: v for k, v in told.items() if k in _CSV})
        case "json" | "ndjson":
            return json(spark, at[1], schema)
        case "arrow":
            return arrow(spark, at[1])
        case "avro":
            return avro(spark, at[1])
        case "orc":
            return orc(spark, at[1])
        case other:
            raise ValueError(f"no such format: {other}")
