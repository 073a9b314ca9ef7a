"""DataFrames to files, with the modes append, overwrite and error."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Compression names -> Spark's.
COMPRESSION = {"gzip": "gzip", "gz": "gzip", "bzip2": "bzip2", "zstd": "zstd", "zst": "zstd", "snappy": "snappy", "lz4": "lz4", "uncompressed": "none", "none": "none"}


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), compression: str | None = None, **options) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        if compression.lower() not in COMPRESSION:
            raise ValueError(f"Spark writes no {compression}")
        writer = writer.option("compression", COMPRESSION[compression.lower()])
    if kind == "csv":
        options = {"header": True} | options
    writer.options(**options).format({"ndjson": "json"}.get(kind, kind)).save(path)


def copy(df: DataFrame, path: str, rest: str = "") -> None:
    """What follows the path of a COPY: STORED AS, PARTITIONED BY and OPTIONS; without STORED AS the path's ending says the format."""
    kind, parts = re.search(r"\bSTORED\s+AS\s+(\w+)", rest, re.I), re.search(r"\bPARTITIONED\s+BY\s*\(([^)]*)\)", rest, re.I)
    ending = re.search(r"\.(parquet|csv|json|orc)/?$", path, re.I)
    options = dict(re.findall(r"""['"]?(?:format\.)?(\w+)['"]?\s+['"]([^'"]*)['"]""", re.search(r"\bOPTIONS\s*\((.*)\)", rest, re.I | re.S)[1])) if re.search(r"\bOPTIONS\s*\(", rest, re.I) else {}
    names = {"has_header": "header", "delimiter": "sep"}
    squeezed = options.pop("compression", None)
    write(df, path, (kind or ending or ["", "parquet"])[1].lower(), partition_by=[c.strip() for c in parts[1].split(",")] if parts else (), compression=squeezed, **{names.get(k, k): v for k, v in options.items()})
