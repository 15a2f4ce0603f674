"""Sinks: JSON lines, shards, flat token files with masks, dead letters and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.ordering import running
from quarrymill.sources.readers import open_path


def write_lines(df: DataFrame, folder: str, compression: str = "gzip", replace: bool = False) -> None:
    """JSON lines; fails if the folder exists, unless it may be replaced."""
    df.write.mode("overwrite" if replace else "errorifexists").option("compression", compression).json(folder)


def write_lines_in_order(df: DataFrame, folder: str, order: str, compression: str = "gzip") -> None:
    """JSON lines whose files, read one after the other by name, give the order: ranges of it are written in parallel."""
    df.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("errorifexists").option("compression", compression).json(folder)


def write_shards(df: DataFrame, folder: str, shards: int) -> None:
    """So many Parquet files of about equal size."""
    df.repartition(shards).write.mode("errorifexists").parquet(folder)


def write_by_source(df: DataFrame, folder: str, source: str, compression: str = "gzip") -> None:
    """JSON lines in one folder for each source, as many files each as tasks hold rows of it."""
    df.write.mode("errorifexists").partitionBy(source).option("compression", compression).json(folder)


def _writer(columns: dict[str, tuple[str, str]], name, folder):
    """Appends the rows' lists to one flat file a column; a file has its name only when it is complete."""

    def write(batches):
        outs, rows, tokens = {}, 0, 0
        target = None
        for b in batches:
            for values in b.itertuples(index=False):
                row = dict(zip(b.columns, values))
                if target is None:
                    target = name(row)
                for c, (dtype, suffix) in columns.items():
                    a = np.asarray(row[c], dtype=np.int64)
                    most = np.iinfo(dtype).max
                    if len(a) and (a.min() < 0 or a.max() > most):
                        raise ValueError(f"{c}: a value outside 0..{most}")
                    if c not in outs:
                        where, path = open_path(f"{folder}/{target}{suffix}")
                        outs[c] = where, path, where.open_output_stream(path + ".tmp")
                    outs[c][2].write(a.astype(dtype).tobytes())
                rows += 1
                tokens += len(row[next(iter(columns))])
        for where, path, out in outs.values():
            out.close()
            where.move(path + ".tmp", path)
        if target is not None:
            yield pd.DataFrame({"file": [f"{folder}/{target}"], "rows": [rows], "tokens": [tokens]})

    return write


def write_tokens(df: DataFrame, folder: str, tokens: str, order: str, dtype: str = "uint16", mask: str | None = None, mask_dtype: str = "uint8") -> list[tuple[str, int, int]]:
    """Flat token files (and mask files beside them), one for each range of the order column, named by it so that their
    order is the data's. Returns (file without suffix, rows, tokens) of each. The folder is one that all executors share."""
    where, path = open_path(folder)
    where.create_dir(path, recursive=True)
    columns = {tokens: (dtype, ".bin")} | ({mask: (mask_dtype, ".mask.bin")} if mask else {})
    run = _writer(columns, lambda r: f"part-{int(r[order]):012d}", folder)
    parts = df.select(order, *columns).repartitionByRange(F.col(order)).sortWithinPartitions(order).mapInPandas(run, "file string, rows long, tokens long")
    return sorted(tuple(r) for r in parts.collect())  # as many as files


def write_tokens_rolling(df: DataFrame, folder: str, tokens: str, order: str, max_tokens: int, dtype: str = "uint16", mask: str | None = None) -> list[tuple[str, int, int]]:
    """As write_tokens, with a new file from the row on that begins behind a multiple of max_tokens.

    Files hold max_tokens tokens but for the row that crosses the mark, which is never cut. order is an integer column. A
    file's rows are in the memory of one task, which max_tokens bounds."""
    where, path = open_path(folder)
    where.create_dir(path, recursive=True)
    columns = {tokens: (dtype, ".bin")} | ({mask: ("uint8", ".mask.bin")} if mask else {})
    numbered = running(df.select(order, *columns), F.size(tokens), [order], F.floor(F.col(order) / 4096), "_tokens_before").withColumn("_file", F.floor(F.col("_tokens_before") / max_tokens))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        run = _writer(columns, lambda r: f"part-{int(r['_file']):06d}", folder)
        return next(run(iter([group.sort_values(order)])))

    parts = numbered.groupBy("_file").applyInPandas(write, "file string, rows long, tokens long")
    return sorted(tuple(r) for r in parts.collect())


def dead_letters(df: DataFrame, good: Column, index: Column, error: str, message: Column) -> DataFrame:
    """index, error, message of the rows that don't pass; a null test fails."""
    return df.where(~F.coalesce(good, F.lit(False))).select(index.alias("index"), F.lit(error).alias("error"), message.alias("message"))


def write_summary(df: DataFrame, path: str, **measures: Column) -> DataFrame:
    """One JSON line of measures; the row is returned as a frame."""
    row = df.agg(*[v.alias(k) for k, v in measures.items()])
    row.coalesce(1).write.mode("overwrite").json(path)
    return row
