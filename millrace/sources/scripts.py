"""User scripts by name: table functions in SQL over a TABLE argument, with named inputs, outputs and options."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def register_script(
    spark: SparkSession, name: str, work: type, inputs: Sequence[str], outputs: str, partition_by: Sequence[str] = (), order_by: Sequence[str] = ()
) -> None:
    """Make ``select * from <name>(table(t), option => value)`` call a class of the user's.

    An object ``work(**options)`` is made for each partition: the rows that agree in ``partition_by``, in the order of ``order_by``
    (without both, as the table lies). ``row(*values)`` gets the columns ``inputs`` of one row at a time and ``end()``, if there is
    one, is called after the last; both may return an iterable of output rows (tuples with the columns of ``outputs``, a
    DDL string). Rows go through one by one, so a partition takes no more memory than the object keeps. Columns
    that the table lacks are an error before anything runs. An existing function of the name is replaced.
    """
    schema = _parse_datatype_string(outputs)
    if not isinstance(schema, StructType):
        raise ValueError("outputs name columns and their types")
    needed = list(dict.fromkeys([*inputs, *partition_by, *order_by]))
    inputs = tuple(inputs)
    keys, order = [PartitioningColumn(f"`{c}`") for c in partition_by], [OrderingColumn(f"`{c}`") for c in order_by]
    ends = hasattr(work, "end")

    class Script:
        @staticmethod
        def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument is a table: table(name)")
            missing = [c for c in needed if c not in table.dataType.fieldNames()]
            if missing:
                raise ValueError(f"the table lacks {missing}")
            return AnalyzeResult(schema=schema, partitionBy=keys, orderBy=order)

        def __init__(self) -> None:
            self.work = None

        def eval(self, row: Row, **options) -> Iterator[tuple]:
            if self.work is None:
                self.work = work(**options)
            yield from self.work.row(*[row[c] for c in inputs]) or ()

        def terminate(self) -> Iterator[tuple]:
            if self.work is not None and ends:
                yield from self.work.end() or ()

    spark.udtf.register(name, udtf(Script))
