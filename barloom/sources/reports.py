"""Reports of a result: CSV and JSON as folders of files that Spark writes, Markdown as one page of a table that is small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a page; a longer result is no report but a table.
PAGE_ROWS = 2000


def markdown(frame: DataFrame, title: str, order: list[str] | None = None, digits: int = 4) -> str:
    """A page with the frame as a table, in the order of columns; raises if it is longer than PAGE_ROWS."""
    rows = frame.orderBy(*(order or frame.columns)).limit(PAGE_ROWS + 1).collect()
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"over {PAGE_ROWS} rows: write it as CSV or JSON")

    def cell(x: object) -> str:
        return "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")

    right = [f.dataType.typeName() in ("double", "float", "long", "integer") for f in frame.schema]
    lines = [f"# {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "|".join("---:" if r else "---" for r in right) + "|"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), "", f"{len(rows)} rows"]) + "\n"


def write_report(frame: DataFrame, path: str, title: str, formats: tuple[str, ...] = ("csv", "json", "md"), order: list[str] | None = None) -> list[str]:
    """path/csv, path/json and path/md, each a folder any Hadoop file system can hold; the folders written."""
    spark, out = frame.sparkSession, []
    plain = frame.select(*[F.to_json(c).alias(c) if frame.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(f"`{c}`") for c in frame.columns])
    for kind in formats:
        at = f"{path.rstrip('/')}/{kind}"
        if kind == "csv":
            plain.write.mode("overwrite").option("header", True).csv(at)
        elif kind == "json":
            frame.write.mode("overwrite").option("ignoreNullFields", False).json(at)
        elif kind == "md":
            spark.createDataFrame([(markdown(plain, title, order),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(at)
        else:
            raise ValueError(f"no such format: {kind}")
        out.append(at)
    return out
