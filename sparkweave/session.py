"""The session: registers tables, takes SQL, returns lazy queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkweave import dialect, options
from sparkweave.frame import Query
from sparkweave.sources import readers, writers

_NAME = r'(?:"[^"]+"|`[^`]+`|[\w.]+)'


def spark_session(app: str = "sparkweave", master: str | None = None, log_level: str | None = None, worker_env: dict[str, str] | None = None, **settings: str) -> SparkSession:
    """A Spark session with the settings this engine counts on: UTC, adaptive plans, Arrow transfer.

    worker_env goes to the environment of the executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**defaults, **{f"spark.executorEnv.{k}": v for k, v in (worker_env or {}).items()}, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if log_level:
        spark.sparkContext.setLogLevel(log_level)
    return spark


class Session:
    """A session on a Spark session of its own (shared context, own views and settings), or on the one given.

    prefetch_buffer_size and partitions_per_processor are accepted and change nothing: Spark's shuffle
    fetches ahead, and an executor runs as many tasks as it has cores. The pool bounds are those of
    dynamic allocation, which only a new Spark context can take up.
    """

    def __init__(self, batch_size: int = 8192, prefetch_buffer_size: int = 0, partitions_per_processor: int | None = None, processor_pool_min: int = 1, processor_pool_max: int = 100, spark: SparkSession | None = None):
        active = spark or SparkSession.getActiveSession()
        if active is None:
            active = spark_session(**{"spark.dynamicAllocation.enabled": "true", "spark.dynamicAllocation.shuffleTracking.enabled": "true", "spark.dynamicAllocation.minExecutors": str(processor_pool_min), "spark.dynamicAllocation.maxExecutors": str(processor_pool_max)})
        self.spark = spark or active.newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.batch_size, self._prepared, self._owned = batch_size, {}, set()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Drop the tables that this session registered; the Spark session goes on."""
        for name in sorted(self._owned):
            self.spark.catalog.dropTempView(name)
        self._owned.clear()

    def _register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        self._owned.add(name)

    def register_parquet(self, name: str, path: str) -> None:
        self._register(name, readers.parquet(self.spark, path))

    def register_csv(self, name: str, path: str, **csv_options) -> None:
        self._register(name, readers.csv(self.spark, path, **csv_options))

    def register_json(self, name: str, path: str) -> None:
        self._register(name, readers.json(self.spark, path))

    def register_arrow(self, name: str, path: str) -> None:
        self._register(name, readers.arrow(self.spark, path))

    def register_avro(self, name: str, path: str) -> None:
        self._register(name, readers.avro(self.spark, path))

    def register_listing_table(self, name: str, path: str, file_extention: str = "parquet") -> None:
        """A folder of Parquet files; the extension only says how the names end that count. Folders key=value give columns."""
        self._register(name, readers.listing(self.spark, path, file_extention))

    def register_dataframe(self, name: str, df: DataFrame) -> None:
        self._register(name, df)

    def register_udf(self, name: str, function, returns: str | None = None) -> None:
        """A scalar function, or an aggregate one if it is a pandas_udf of Series to a scalar, under a name for SQL."""
        self.spark.udf.register(name, function) if returns is None else self.spark.udf.register(name, function, returns)

    register_udaf = register_udf

    def register_udtf(self, name: str, function) -> None:
        """A table function (pyspark.sql.functions.udtf) under a name for SQL."""
        self.spark.udtf.register(name, function)

    def set(self, option: str, value: str) -> None:
        options.apply(self.spark, option, value)

    def get_target_partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def table(self, name: str) -> Query:
        return Query(self.spark.table(name), self.batch_size)

    def sql(self, query: str, **params) -> Query:
        """A lazy handle on one statement; statements that define or write something take effect now. params fill :names."""
        return Query(self._run(query, params), self.batch_size)

    def run(self, text: str) -> list[Query]:
        """All statements of a text, in order."""
        return [self.sql(statement) for statement in dialect.statements(text)]

    def _run(self, query: str, params: dict) -> DataFrame:
        text = query.strip().rstrip(";").strip()
        word = text.split(None, 1)[0].upper() if text else ""
        handler = {"CREATE": self._create, "COPY": self._copy, "PREPARE": self._prepare, "EXECUTE": self._execute, "DEALLOCATE": self._deallocate, "EXPLAIN": self._explain, "DELETE": self._delete, "UPDATE": self._update}.get(word)
        out = handler(text) if handler else None
        if out is not None:
            return out
        if re.search(r"\binformation_schema\s*\.", text, re.I):
            text = self._schema_views(text)
        return self.spark.sql(dialect.rewrite(text), args=params or None)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "status string")

    def _create(self, text: str) -> DataFrame | None:
        if m := re.match(r"CREATE\s+(UNBOUNDED\s+)?EXTERNAL\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*(\(.*?\))?\s*(.*)$", text, re.I | re.S):
            exists = self.spark.catalog.tableExists(m[3])
            if exists and not m[2]:
                raise ValueError(f"table {m[3]} exists")
            if not exists:
                self._register(m[3], readers.external(self.spark, m[4], m[5], bool(m[1])))
            return self._nothing()
        if m := re.match(rf"CREATE\s+(OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW\s+({_NAME})\s*(.*)$", text, re.I | re.S):
            if not m[1] and self.spark.catalog.tableExists(m[2]):
                raise ValueError(f"table {m[2]} exists")
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {m[2]} {dialect.rewrite(m[3])}")
            self._owned.add(m[2].strip('"`'))
            return self._nothing()
        if m := re.match(rf"CREATE\s+(?:SCHEMA|DATABASE)\s+(IF\s+NOT\s+EXISTS\s+)?({_NAME})$", text, re.I):
            self.spark.sql(f"CREATE SCHEMA {'IF NOT EXISTS ' if m[1] else ''}{dialect.rewrite(m[2])}")
            return self._nothing()
        if re.match(r"CREATE\s+CATALOG\b", text, re.I):
            raise ValueError("catalogs are configured: set spark.sql.catalog.<name> when the Spark session is made")
        return None

    def _replace(self, table: str, query: str) -> DataFrame:
        """A table of files with the rows of a query over it: written beside it, in its format and partitions, then put in
        its place. The old rows go last: after a failure they are there, under the table's name or `<name>__old_…`."""
        tag, plain = uuid.uuid4().hex[:8], table.strip('`"')
        beside, old = f"`{plain}__new_{tag}`", f"`{plain}__old_{tag}`"
        told = {r[0]: r[1] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        parts = [f"`{c.name}`" for c in self.spark.catalog.listColumns(plain) if c.isPartition]
        self.spark.sql(f"CREATE TABLE {beside} USING {told.get('Provider', 'parquet')}{f' PARTITIONED BY ({", ".join(parts)})' if parts else ''} AS {query}")
        self.spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {beside} RENAME TO `{plain}`")
        self.spark.sql(f"DROP TABLE {old}")
        return self._nothing()

    def _delete(self, text: str) -> DataFrame:
        m = re.match(rf"DELETE\s+FROM\s+({_NAME})(?:\s+WHERE\s+(.*))?$", text, re.I | re.S)
        return self._replace(m[1], f"SELECT * FROM {m[1]} WHERE NOT coalesce({dialect.rewrite(m[2]) if m[2] else 'true'}, false)")

    def _update(self, text: str) -> DataFrame:
        m = re.match(rf"UPDATE\s+({_NAME})\s+SET\s+(.*)$", text, re.I | re.S)
        changes, where = dialect.clause(dialect.tokens(dialect.rewrite(m[2])), "WHERE")
        new = {name.strip().strip('`"').lower(): value for name, value in (dialect.text_of(c).split("=", 1) for c in dialect.split(changes))}
        hit = f"coalesce({dialect.text_of(where) or 'true'}, false)"
        fields = self.spark.table(m[1]).schema
        columns = [f"CAST(CASE WHEN {hit} THEN {new[f.name.lower()]} ELSE `{f.name}` END AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name.lower() in new else f"`{f.name}`" for f in fields]
        return self._replace(m[1], f"SELECT {', '.join(columns)} FROM {m[1]}")

    def _copy(self, text: str) -> DataFrame:
        m = re.match(rf"COPY\s+(\(.*\)|{_NAME})\s+TO\s+'([^']+)'\s*(.*)$", text, re.I | re.S)
        if not m:
            raise ValueError(f"cannot read: {text}")
        source = m[1][1:-1] if m[1].startswith("(") else f"SELECT * FROM {m[1]}"
        writers.copy(self.spark.sql(dialect.rewrite(source)), m[2], m[3])
        return self._nothing()

    def _prepare(self, text: str) -> DataFrame:
        m = re.match(r"PREPARE\s+(\w+)\s*(?:\([^)]*\))?\s+AS\s+(.*)$", text, re.I | re.S)
        if not m:
            raise ValueError(f"cannot read: {text}")
        parts = dialect.tokens(dialect.rewrite(m[2]))
        self._prepared[m[1].lower()] = dialect.text_of([(k, f":p{t[1:]}") if k == "param" else (k, t) for k, t in parts])
        return self._nothing()

    def _execute(self, text: str) -> DataFrame | None:
        m = re.match(r"EXECUTE\s+(\w+)\s*(?:\((.*)\))?$", text, re.I | re.S)
        if not m or m[1].lower() not in self._prepared:
            return None
        values = [dialect.text_of(p).strip() for p in dialect.split(dialect.tokens(m[2]))] if m[2] else []
        args = self.spark.sql("SELECT " + ", ".join(values)).first() if values else ()
        return self.spark.sql(self._prepared[m[1].lower()], args={f"p{k}": v for k, v in enumerate(args, 1)})

    def _deallocate(self, text: str) -> DataFrame:
        self._prepared.pop(text.split()[-1].lower(), None)
        return self._nothing()

    def _explain(self, text: str) -> DataFrame:
        m = re.match(r"EXPLAIN\s+(?:(ANALYZE)\s+)?(?:(VERBOSE|EXTENDED|FORMATTED|CODEGEN|COST)\s+)?(.*)$", text, re.I | re.S)
        query = dialect.rewrite(m[3])
        if m[1]:
            return self.spark.createDataFrame([(Query(self.spark.sql(query)).analyzed_plan(),)], "plan string")
        mode = {"VERBOSE": "EXTENDED"}.get((m[2] or "").upper(), (m[2] or "FORMATTED").upper())
        return self.spark.sql(f"EXPLAIN {mode} {query}")

    def _schema_views(self, text: str) -> str:
        tables, columns = [], []
        for t in self.spark.catalog.listTables():
            kind = "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE"
            tables.append(("spark_catalog", t.namespace[0] if t.namespace else "default", t.name, kind))
            for k, field in enumerate(self.spark.table(t.name).schema, 1):
                columns.append((*tables[-1][:3], field.name, k, "YES" if field.nullable else "NO", field.dataType.simpleString()))
        self.spark.createDataFrame(tables, "table_catalog string, table_schema string, table_name string, table_type string").createOrReplaceTempView("__schema_tables")
        self.spark.createDataFrame(columns, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string").createOrReplaceTempView("__schema_columns")
        return re.sub(r"\binformation_schema\s*\.\s*(tables|columns)\b", r"__schema_\1", text, flags=re.I)


class Validator:
    """The same tables in DuckDB, as an independent check of results."""

    def __init__(self):
        import duckdb

        self.connection = duckdb.connect()

    def register_parquet(self, name: str, path: str) -> None:
        self.connection.sql(f"""CREATE OR REPLACE VIEW "{name}" AS SELECT * FROM read_parquet('{path}')""")

    def register_listing_table(self, name: str, path: str, file_extention: str = "parquet") -> None:
        self.register_parquet(name, f"{path.rstrip('/')}/**/*.{file_extention.lstrip('.')}")

    def collect_sql(self, query: str) -> list:
        return self.connection.sql(query).to_arrow_table().to_batches()
