"""Streams that maintain the symbol and sector tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marketlake.functions.keyed import keep_last
from marketlake.operators import symbols as sym, taxonomy as tax
from marketlake.sources.datasets import VersionedTable

__all__ = ["sector_upserts", "symbol_upserts"]

BatchWriter = Callable[[DataFrame, int], None]


def symbol_upserts(table: VersionedTable) -> BatchWriter:
    """foreachBatch writer: apply each delivered snapshot (exchange, code, meta) to the table.

    Starts from the stored table whatever the batch number, so a new checkpoint loses nothing;
    applying a batch again changes nothing. A batch has to hold whole snapshots of the exchanges
    it touches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(sym.apply_snapshot(table.latest(), batch), table.following())

    return write


def sector_upserts(table: VersionedTable) -> BatchWriter:
    """foreachBatch writer: merge sector records into the table, last record per key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        incoming = keep_last(batch, ["taxonomy", "source_code"]) if "_seq" in batch.columns else batch
        table.write(tax.upsert_sectors(table.latest(), incoming.drop("_seq")), table.following())

    return write
