"""The audit log: rows are appended and never changed, and a row that is written twice is there once."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.tables import insert_missing
from .snapshots import View


def events(rows: DataFrame) -> DataFrame:
    """Rows of ``schemas.AUDIT_LOG`` from what is given of them; without ``id``, one of all other columns' values."""
    names = [f.name for f in schemas.AUDIT_LOG.fields if f.name != "id"]
    whole = rows.select(*rows.columns, *(F.lit(None).cast(schemas.AUDIT_LOG[n].dataType).alias(n) for n in names if n not in rows.columns))
    text = [F.to_json(n) if n == "details" else F.col(n).cast("string") for n in names]
    ident = F.sha2(F.concat_ws("\0", *(F.coalesce(x, F.lit("")) for x in text)), 256)
    return whole.select((F.coalesce("id", ident) if "id" in rows.columns else ident).alias("id"), *names)


class AuditLog:
    def __init__(self, table: View):
        self.table = table

    def record_independently(self, rows: DataFrame) -> None:
        """Written at once, whatever becomes of the work around it."""
        self.table.append(insert_missing(self.table.read(), events(rows), ["id"]))

    @contextmanager
    def unit(self):
        """A unit of work: what is recorded within it (``record(rows)``) is written when it ends, and not if it fails."""
        held: list[DataFrame] = []
        yield held.append
        if held:
            whole = held[0]
            for rows in held[1:]:
                whole = whole.unionByName(rows, allowMissingColumns=True)
            self.record_independently(whole)
