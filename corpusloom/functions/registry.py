"""The engine's functions by name, for queries in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: The table function's columns: a row for each cell of a grid.
CELLS = "sheet int, sheet_name string, ref string, col string, row int, t string, v string, number double"


@udtf(returnType=CELLS)
class GridCells:
    """``SELECT ... FROM t, LATERAL grid_cells(t.grid)``: the cells of one typed grid; ``sources.documents.cells`` is the native
    form over a whole table."""

    def eval(self, grid):
        for k, sheet in enumerate(grid["sheets"] or [] if grid else []):
            for c in sheet["cells"] or []:
                letters = c["ref"].rstrip("0123456789")
                try:
                    number = float(c["v"])
                except (TypeError, ValueError):
                    number = None
                yield k, sheet["name"], c["ref"], letters, int(c["ref"][len(letters) :] or 0), c["t"], c["v"], number


def register(spark: SparkSession) -> None:
    """redact_secrets(text), html_to_text(html), decode_chain(bytes, charset), parse_message(raw, mailbox, date) and grid_cells(grid)."""
    from ..sources import charsets, markup, messages
    from . import redact

    spark.udf.register("redact_secrets", redact.redact_secrets)
    spark.udf.register("html_to_text", markup.html_to_text)
    spark.udf.register("decode_chain", charsets.decode_chain)
    spark.udf.register("parse_message", messages._parse)
    spark.udtf.register("grid_cells", GridCells)
