"""Symbol ranges, chunks of lines, and the joins between lines, chunks and enclosing symbols."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET = 8192
#: Files of a batch that are Python objects at a time.
FILES = 64


def clip_ranges(symbols: DataFrame) -> DataFrame:
    """Symbols by (start, end, kind, name), one for each (name, kind, start); each ends before the next one starts."""
    order = Window.partitionBy("path").orderBy("line_start", "line_end", "kind", "name")
    once = symbols.withColumn("cr_n", F.row_number().over(Window.partitionBy("path", "name", "kind", "line_start").orderBy("line_end"))).filter("cr_n = 1").drop("cr_n")
    until = F.greatest(F.col("line_start"), F.least(F.col("line_end"), F.lead("line_start").over(order) - 1))
    return once.withColumn("line_end", F.coalesce(until, F.col("line_end")))


def to_next(symbols: DataFrame) -> DataFrame:
    """Symbols whose range reaches to the line before the next one, the last one's to the end of its file (line_count)."""
    order = Window.partitionBy("path").orderBy("line_start", "name")
    return symbols.withColumn("line_end", F.greatest("line_start", F.coalesce(F.lead("line_start").over(order) - 1, F.col("line_count"))))


def scope_of_lines(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each line with the name and start of the symbol around it that starts last; null outside symbols.

    Ranges are disjoint but for symbols of one line, so a backward fill over one sort by path replaces the range join.
    """
    starts = symbols.groupBy("path", F.col("line_start").alias("line")).agg(F.max_by(F.struct("line_start", "line_end", "name"), F.struct("line_end", "name")).alias("sym"))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    near = lines.join(starts, ["path", "line"], "left").withColumn("sym", F.last("sym", ignorenulls=True).over(order))
    inside = F.col("sym.line_end") >= F.col("line")
    return near.select(*lines.columns, F.when(inside, F.col("sym.name")).alias("scope"), F.when(inside, F.col("sym.line_start")).alias("scope_start"))


def cut_chunks(lines: list[str], ranges: list[tuple[int, int]], target: int = TARGET) -> list[tuple[int, int]]:
    """Line ranges of about `target` bytes: gaps and symbols in order, long ones cut, neighbours joined while they fit."""
    size = [len(line.encode()) + 1 for line in lines]
    spans, at = [], 1
    for first, last in sorted(ranges):
        first, last = max(first, at), min(last, len(lines))
        if first > last:
            continue
        if at < first:
            spans.append((at, first - 1))
        spans.append((first, last))
        at = last + 1
    if at <= len(lines):
        spans.append((at, len(lines)))
    pieces = []
    for first, last in spans:
        start, held = first, 0
        for k in range(first, last + 1):
            held += size[k - 1]
            if held >= target:
                pieces.append([start, k, held])
                start, held = k + 1, 0
        if start <= last:
            pieces.append([start, last, held])
    out: list[list[int]] = []
    for first, last, held in pieces:
        if out and first <= out[-1][1] + 1 and out[-1][2] + held <= target:
            out[-1][1:] = [last, out[-1][2] + held]
        else:
            out.append([first, last, held])
    return [(a, b) for a, b, _ in out if any(line.strip() for line in lines[a - 1 : b])]


def chunk_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, start_line, end_line of every chunk. Each file is one row with its symbol ranges; cutting is sequential within it."""
    ranges = symbols.groupBy("path").agg(F.collect_list(F.struct("line_start", "line_end")).alias("ranges"))
    joined = files.select("path", "content").join(ranges, "path", "left").select("path", "content", "ranges.line_start", "ranges.line_end")

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                rows = []
                for path, content, first, last in zip(*(column.to_pylist() for column in batch.slice(at, FILES).columns), strict=True):
                    lines = (content or "").replace("\r\n", "\n").split("\n")
                    if lines and lines[-1] == "":
                        lines.pop()
                    rows += [(path, a, b) for a, b in cut_chunks(lines, list(zip(first or (), last or (), strict=True)))]
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "start_line", "end_line"])

    return joined.mapInArrow(work, "path string, start_line bigint, end_line bigint")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id by (path, start): counts of earlier ranges plus the place within the range, so that no single task sorts all."""
    spread = chunks.repartitionByRange("path").sortWithinPartitions("path", "start_line").withColumn("nc_part", F.spark_partition_id())
    per_path = spread.groupBy("path").agg(F.count("*").alias("nc_n"))
    paths = per_path.repartitionByRange("path").withColumn("nc_part", F.spark_partition_id())
    within = Window.partitionBy("nc_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    # a row a partition: partitions are few
    totals = paths.groupBy("nc_part").agg(F.sum("nc_n").alias("nc_total"))
    before = totals.select("nc_part", F.coalesce(F.sum("nc_total").over(Window.orderBy("nc_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("nc_before"))
    first = paths.withColumn("nc_in", F.coalesce(F.sum("nc_n").over(within), F.lit(0))).join(before, "nc_part").select("path", (F.col("nc_before") + F.col("nc_in")).alias("nc_first"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("start_line")) - 1
    return chunks.join(first, "path").select((F.col("nc_first") + place).cast("bigint").alias("chunk_id"), *chunks.columns)


def definition_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lower-case symbol name and the first chunk that holds its start line."""
    inside = (symbols["path"] == chunks["path"]) & symbols["line_start"].between(chunks["start_line"], chunks["end_line"])
    hit = symbols.join(chunks, inside).groupBy(F.lower("name").alias("name"), symbols["path"], "line_start").agg(F.min("start_line").alias("start_line"))
    return hit.select("name", "path", "start_line").distinct()
