"""Changes that arrive as files: each micro-batch of N-Triples or N-Quads becomes one proposed candidate.

Spark's checkpoint remembers which files were read, and the batch number in the note keeps a batch that is run
again after a failure from being proposed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..sources.rdf import read_lines


def watch(store: Store, folder: str, g: str, checkpoint: str, agent: str = "stream", once: bool = True) -> StreamingQuery:
    """Propose additions to ``g`` from files dropped in ``folder``; nothing is approved here."""

    def propose(lines: DataFrame, batch: int) -> None:
        note = f"batch {batch}"
        if any(c["target"] == g and c["agent"] == agent and c["note"] == note for c in store.catalog["candidates"]):
            return
        got = read_lines(lines, g).distinct()
        if not got.isEmpty():
            store.propose_statements(g, got, agent=agent, note=note)

    stream = store.spark.readStream.format("text").load(folder).writeStream.foreachBatch(propose).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()
