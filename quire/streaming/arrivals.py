"""Analysis of documents as they arrive. Documents are independent, so a stream needs no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import Analysis, analyse


def analyse_stream(docs: DataFrame, out: str, checkpoint: str, *, view: Callable[[Analysis], DataFrame] = lambda a: a.plan.drop("scores"), trigger: dict | None = None) -> StreamingQuery:
    """Analyse each micro-batch of ``doc_id, text`` and write the view to a folder of its own under out.

    A batch that is run again after a failure overwrites its folder, so each document's result is there once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        view(analyse(rows)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
