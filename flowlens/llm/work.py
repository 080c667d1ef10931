"""Shared helpers of the document operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.operators.joins import spread_join
from flowlens.storage import numbered, placed, removed, shared_folder, work_folder, written

__all__ = ["numbered", "placed", "removed", "row_key", "shared_folder", "spread_join", "unit", "work_folder", "written"]


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a document's id and text."""
    name = F.coalesce(F.md5(doc_id.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.coalesce(text, F.lit("")))))


def unit(value: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(value, 11).cast("double") * F.lit(2.0**-53)
