"""Tables kept in order of time, which tasks read in parts of bounded size, as often as they like."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.shared import Scratch

#: Bytes of a row group: what a reader decodes at once.
GROUP_BYTES = 1 << 20
#: Files a reader holds open, each with the row group it read last.
OPEN = 16


class Timed:
    """Rows (ts, symbol, numbers) written once, each time in one file and files by (ts, symbol); times are numbered from 0.

    The shared folder must be one that pyarrow opens.  The driver gets a row per time.
    """

    def __init__(self, table: DataFrame, numbers: list[str], label: str):
        scratch = Scratch(table.sparkSession, "timed")
        rows = table.where("ts is not null").select(F.col("ts").cast("long").alias("ts"), F.col("symbol").cast("string").alias("symbol"), *(F.col(f"`{c}`").cast("double").alias(c) for c in numbers))
        rows = rows.repartition("ts").sortWithinPartitions("ts", F.asc_nulls_last("symbol"))
        made = scratch.put("rows", rows, **{"parquet.block.size": GROUP_BYTES})
        known = F.count(F.when(F.col(f"`{label}`").isNotNull() & ~F.isnan(F.col(f"`{label}`")), 1))
        found = made.groupBy(F.col("_metadata.file_name").alias("file"), "ts").agg(F.count("*").alias("n"), known.alias("known")).orderBy("file", "ts").collect()
        self.folder = f"{scratch.path}/rows"
        self.files = list(dict.fromkeys(r.file for r in found))
        at, start = {f: i for i, f in enumerate(self.files)}, dict.fromkeys(self.files, 0)
        pieces = []
        for r in found:
            pieces.append((r.ts, at[r.file], start[r.file], r.n, r.known))
            start[r.file] += r.n
        #: (file, first row, rows, rows with a label) of each time.
        self.pieces = [p[1:] for p in sorted(pieces)]

    def __len__(self) -> int:
        return len(self.pieces)

    def known(self, lo: int, hi: int) -> int:
        return sum(p[3] for p in self.pieces[lo:hi])

    def batches(self, lo: int, hi: int, columns: list[str]) -> Iterator[pa.Table]:
        """The rows of times lo .. hi - 1, in order."""
        fs, root = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.folder))
        held: dict[int, list] = {}  # reader, first row of each group and the end, group read last, its rows
        try:
            for file, start, n, _ in self.pieces[lo:hi]:
                if file not in held:
                    if len(held) >= OPEN:
                        held.pop(next(iter(held)))[0].close(force=True)
                    reader = pq.ParquetFile(fs.open_input_file(f"{root}/{self.files[file]}"))
                    meta = reader.metadata
                    held[file] = [reader, [0, *accumulate(meta.row_group(g).num_rows for g in range(meta.num_row_groups))], None, None]
                h = held[file]
                for g, (a, b) in enumerate(zip(h[1], h[1][1:], strict=False)):
                    if a < start + n and b > start:
                        if h[2] != g:
                            h[2:] = g, h[0].read_row_group(g, columns=columns, use_threads=False)
                        first = max(start, a)
                        yield h[3].slice(first - a, min(start + n, b) - first)
        finally:
            for h in held.values():
                h[0].close(force=True)
