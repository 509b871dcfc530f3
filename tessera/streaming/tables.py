"""Tables over a stream: counts are kept by grouping keys, and the small table is rebuilt for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.options import Options
from tessera.plans.build import BuildResult, build
from tessera.spec import TableSpec

TIMES = "times_seen"


def stream_table(stream: DataFrame, spec: TableSpec, keys: list[str], emit: Callable[[BuildResult, int], None], checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Aggregate a stream by the variables that a table of counts needs and hand ``emit`` a table after each batch.

    The state holds one row for each combination of ``keys``, not the events.  Each batch sees the whole state (complete
    mode), whose rows count as often as they occurred: the work of a batch grows with the combinations, not with the events.
    """
    counted = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias(TIMES))

    def batch(frame: DataFrame, epoch: int) -> None:
        emit(build(spec, frame, options=options, weight=TIMES), epoch)

    return counted.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch).start()
