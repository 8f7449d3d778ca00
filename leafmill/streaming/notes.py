"""Notes arriving as files, stored together with their search postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from leafmill.operators.merge import fold_latest
from leafmill.operators.search import lengths, postings
from leafmill.operators.text_index import StoredIndex
from leafmill.streaming.events import run_available


def ingest_notes(
    stream: DataFrame, root: str, columns: Sequence[str], checkpoint: str | None = None
) -> None:
    """Append notes, postings and document lengths of every batch below ``root``.

    Each batch writes its own folders, so notes and index move together and a
    repeated batch replaces itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        parts = {
            "notes": batch,
            "postings": postings(batch, "id", columns),
            "lengths": lengths(batch, "id", columns),
        }
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        batch.unpersist()

    run_available(stream, "append", store, checkpoint)


def maintain_index(stream: DataFrame, index: StoredIndex, order: Sequence[str], checkpoint: str | None = None, compact_every: int = 50) -> None:
    """Keep a stored index in step with a stream of changes (the documents' columns, ``deleted``, and ``order``).

    Each batch is folded to the last change per id and stored as a segment numbered by the batch, so a repeated batch
    replaces itself. Every ``compact_every`` batches the live rows become one segment again, which bounds what a reader
    has to compare. The index must have been created, with segment 0, before the first batch.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        last = fold_latest(batch.where(batch[index.key].isNotNull()), index.key, order).drop(*order)
        index.apply(last, number + 1)
        batch.unpersist()
        if (number + 1) % compact_every == 0:
            index.compact()

    run_available(stream, "append", store, checkpoint)
