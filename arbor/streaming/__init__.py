"""Index maintenance over a stream of nodes."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arbor.operators.index import build_index
from arbor.settings import Settings


def append_index(nodes: DataFrame, path: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Adds the documents of each micro-batch to the index tables at ``path``, then stops when the source is drained.

    A document's nodes have to come in one batch, as files do; its statistics are its own, so nothing older is rewritten. A
    batch is named by the checkpoint and its number, so one that is played again replaces what it wrote, and one that was
    not written whole is not read.
    """

    def add(batch: DataFrame, number: int) -> None:
        build_index(batch, settings).append(path, f"{zlib.crc32(checkpoint.encode()):08x}-{number}")

    return nodes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
