"""A lazy query: its schema, plans and stages, and its rows as Arrow batches or text."""

from __future__ import annotations

import asyncio
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


def prettify(batches: list[pa.RecordBatch], schema: pa.Schema | None = None) -> str:
    """The rows of Arrow batches as a text table, all of them."""
    if not batches and schema is None:
        return "++\n++"
    names = (schema or batches[0].schema).names
    shown = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = [[shown(v) for v in row] for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
    widths = [max([len(n), *(len(r[k]) for r in rows)]) for k, n in enumerate(names)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths)) + "|"
    return "\n".join([rule, line(names), rule, *(line(r) for r in rows), *([rule] if rows else [])])


def chunked(table: pa.Table, most: int) -> list[pa.RecordBatch]:
    """Batches of at most `most` rows; an empty table has none."""
    return [b for b in table.combine_chunks().to_batches(max_chunksize=most) if b.num_rows]


class BatchStream:
    """Batches one after the other, for `for` as well as `async for`; schema is known before the first."""

    def __init__(self, schema: pa.Schema, batches: Iterator[pa.RecordBatch]):
        self.schema, self._batches = schema, batches

    def __iter__(self) -> BatchStream:
        return self

    def __next__(self) -> pa.RecordBatch:
        return next(self._batches)

    def __aiter__(self) -> BatchStream:
        return self

    async def __anext__(self) -> pa.RecordBatch:
        batch = await asyncio.to_thread(next, self._batches, None)
        if batch is None:
            raise StopAsyncIteration
        return batch


@dataclass(frozen=True)
class Stage:
    """A part of the physical plan between exchanges."""

    stage_id: int
    child_stage_ids: tuple[int, ...]
    num_output_partitions: int
    plan: str

    @property
    def partition_groups(self) -> list[list[int]]:
        """The partitions that run as one task each."""
        return [[p] for p in range(self.num_output_partitions)]

    @property
    def full_partitions(self) -> bool:
        """Every task sees whole partitions."""
        return True

    def plan_bytes(self) -> bytes:
        """The plan of the stage as text, in UTF-8: Spark plans have no binary form."""
        return self.plan.encode()

    def execution_plan(self) -> str:
        return self.plan

    display_execution_plan = execution_plan


class Query:
    """What Session.sql() returns. Nothing runs before collect(), batches() or show(); collect() runs once."""

    def __init__(self, df: DataFrame, batch_size: int = 8192):
        self.df, self.batch_size = df, batch_size
        self._batches: list[pa.RecordBatch] | None = None
        self._stages: list[Stage] | None = None

    def schema(self) -> pa.Schema:
        return self.df.limit(0).toArrow().schema

    def logical_plan(self) -> str:
        return self.df._jdf.queryExecution().analyzed().toString()

    def optimized_logical_plan(self) -> str:
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def execution_plan(self) -> str:
        return self.df._jdf.queryExecution().executedPlan().toString()

    def display_execution_plan(self) -> str:
        """The plan with the details of each node, such as pushed filters and partition counts."""
        jvm = self.df.sparkSession.sparkContext._jvm
        return jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), "formatted")

    def stages(self) -> list[Stage]:
        """The parts into which exchanges cut the plan, inputs first; the last one gives the result."""
        if self._stages is None:
            found: list[Stage] = []

            def children(node) -> list:
                kids = node.children()
                return [kids.apply(k) for k in range(kids.size())]

            def below(node) -> tuple[int, ...]:
                name = node.getClass().getSimpleName()
                if name == "AdaptiveSparkPlanExec":
                    return below(node.executedPlan())
                if name.endswith("QueryStageExec"):
                    return below(node.plan())
                if name in ("ShuffleExchangeExec", "BroadcastExchangeExec"):
                    return (cut(node),)
                return tuple(s for child in children(node) for s in below(child))

            def cut(node) -> int:
                inputs = tuple(s for child in children(node) for s in below(child))
                found.append(Stage(len(found), inputs, max(1, node.outputPartitioning().numPartitions()), node.toString()))
                return found[-1].stage_id

            root = self.df._jdf.queryExecution().executedPlan()
            inputs = below(root)
            found.append(Stage(len(found), inputs, max(1, root.outputPartitioning().numPartitions()), root.toString()))
            self._stages = found
        return self._stages

    def analyzed_plan(self) -> str:
        """Run the query, and its final plan with what each node measured; the last line says how many rows came out."""
        execution = self.df._jdf.queryExecution()
        rows = execution.toRdd().count()

        def items(things) -> list:
            at = things.iterator()
            out = []
            while at.hasNext():
                out.append(at.next())
            return out

        def lines(node, depth: int) -> list[str]:
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                return lines(node.executedPlan(), depth)
            if name.endswith("QueryStageExec"):
                return lines(node.plan(), depth)
            told = ", ".join(f"{m._1()}={m._2().value()}" for m in sorted(items(node.metrics()), key=lambda m: m._1()) if m._2().value() > 0)
            own = f"{'  ' * depth}{node.simpleString(100)}" + (f" [{told}]" if told else "")
            return [own, *(line for child in items(node.children()) for line in lines(child, depth + 1))]

        return "\n".join([*lines(execution.executedPlan(), 0), f"output rows: {rows}"])

    def collect(self) -> list[pa.RecordBatch]:
        """All rows, in batches of at most batch_size; an empty result is remembered like any other."""
        if self._batches is None:
            self._batches = chunked(self.df.toArrow(), self.batch_size)
        return self._batches

    def batches(self) -> BatchStream:
        """The rows as a stream of batches: a partition at a time comes to the driver."""
        schema = self.schema()
        return BatchStream(schema, self._stream(schema) if self._batches is None else iter(self._batches))

    def _stream(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        most = self.batch_size

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, most):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, whole.schema) as out:
                        out.write_batch(whole.slice(at, most))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ipc"])

        # by position, since columns may share a name
        numbered = self.df.toDF(*(f"c{k}" for k in range(len(schema))))
        held: list[pa.RecordBatch] = []
        for row in numbered.mapInArrow(packed, "ipc binary").toLocalIterator(prefetchPartitions=True):
            for batch in pa.ipc.open_stream(bytes(row["ipc"])):
                held.append(pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema))
            if sum(b.num_rows for b in held) >= most:
                *full, last = chunked(pa.Table.from_batches(held, schema), most)
                yield from full if last.num_rows < most else [*full, last]
                held = [last] if last.num_rows < most else []
        yield from held and chunked(pa.Table.from_batches(held, schema), most)

    def show(self) -> None:
        print(prettify(self.collect(), self.schema()))
