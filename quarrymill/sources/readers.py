"""Sources: JSON lines, delimited text, generated records, archives and flat token files.

Token files are read in byte ranges by the tasks, through pyarrow's file systems, so that a path may be local to a
shared mount or on HDFS, S3 or GCS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str | list[str], schema: str | None = None, header: bool = True) -> DataFrame:
    """A data set by its suffix: json, jsonl (also .gz, .zst), csv, tsv, txt or parquet; several paths are concatenated.

    Every line counts, also a last one without line end, as do all members of a gzip file. A CSV without header has the
    columns _c0, _c1, ... or those of the schema.
    """
    paths = [path] if isinstance(path, str) else list(path)
    name = paths[0].rstrip("/").lower()
    for end in (".gz", ".zst", ".bz2"):
        name = name.removesuffix(end)
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = name.rsplit(".", 1)[-1]
    if kind in ("json", "jsonl"):
        return reader.json(paths)
    if kind in ("csv", "tsv"):
        return reader.csv(paths, header=header, sep="\t" if kind == "tsv" else ",", inferSchema=schema is None)
    if kind == "txt":
        return spark.read.text(paths)
    return reader.parquet(*paths)


def read_compressed(spark: SparkSession, path: str | list[str], partitions: int, schema: str | None = None) -> DataFrame:
    """Compressed JSON lines: one file is one task, so the rows are spread over the partitions before anything else."""
    return read_any(spark, path, schema).repartition(partitions)


def numbered_paths(template: str, first: int, last: int, digits: int = 4) -> list[str]:
    """Paths of numbered files: the template's {} takes the zero-padded number."""
    return [template.format(str(k).zfill(digits)) for k in range(first, last + 1)]


def read_folder_texts(spark: SparkSession, folder: str, text: str = "text") -> DataFrame:
    """The texts of all JSON lines files of a folder, also those in folders within it."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(folder).select(text)


def from_generator(spark: SparkSession, make: Callable[[int], Iterable[tuple]], schema: str, parts: int) -> DataFrame:
    """The records that make(part) yields, a task for each part: the driver holds none of them."""

    names = spark.createDataFrame([], schema).columns

    def run(batches):
        for b in batches:
            for part in b["id"]:
                rows = []
                for r in make(int(part)):
                    rows.append(r)
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def open_path(path: str):
    """(file system, path on it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def file_size(path: str) -> int:
    where, p = open_path(path)
    info = where.get_file_info(p)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def read_tokens(
    spark: SparkSession, paths: list[str], chunk: int, dtype: str = "uint16", blocks: int = 4096, masks: list[str] | None = None, mask_dtype: str = "uint8", metadata: list[str] | None = None, keep: Callable[[np.ndarray], bool] | None = None
) -> DataFrame:
    """idx, file, chunk_id, input_ids (and label_mask, metadata): flat token files cut into chunks of equal length.

    idx numbers the chunks over all files in their order; what is left at a file's end is dropped. Mask files must have
    as many chunks as their token files (ValueError). metadata has a value for each file. keep drops chunks; the others
    keep their numbers. A task reads byte ranges of at most `blocks` chunks; files must be visible to all executors.
    """
    width, mask_width = np.dtype(dtype).itemsize, np.dtype(mask_dtype).itemsize
    if masks is not None and len(masks) != len(paths) or metadata is not None and len(metadata) != len(paths):
        raise ValueError("as many masks and metadata as token files are wanted")
    ranges, base = [], 0
    for k, p in enumerate(paths):
        n = file_size(p) // width // chunk
        if masks is not None and file_size(masks[k]) // mask_width // chunk != n:
            raise ValueError(f"{masks[k]} has not as many chunks as {p}")
        ranges += [(p, masks[k] if masks else None, metadata[k] if metadata else None, first, min(blocks, n - first), base + first) for first in range(0, n, blocks)]
        base += n

    def part(path, kind, first, count):
        where, p = open_path(path)
        size = np.dtype(kind).itemsize * chunk
        with where.open_input_file(p) as f:
            return np.frombuffer(f.read_at(count * size, first * size), dtype=kind).reshape(count, chunk)

    def read(batches):
        for b in batches:
            for p, m, meta, first, count, at in b.itertuples(index=False):
                a = part(p, dtype, first, count)
                out = {"idx": np.arange(at, at + count), "file": p, "chunk_id": np.arange(first, first + count), "input_ids": list(a.astype(np.int32))}
                if masks is not None:
                    out["label_mask"] = list(part(m, mask_dtype, first, count).astype(np.int32))
                if metadata is not None:
                    out["metadata"] = meta
                df = pd.DataFrame(out)
                yield df[[bool(keep(x)) for x in a]] if keep else df

    schema = "idx long, file string, chunk_id long, input_ids array<int>" + (", label_mask array<int>" if masks is not None else "") + (", metadata string" if metadata is not None else "")
    plan = spark.createDataFrame(ranges, "path string, mask string, metadata string, first long, count long, at long").repartition(max(1, min(len(ranges), 4096)), "path", "first")
    return plan.mapInPandas(read, schema)


def slice_of(df: DataFrame, key: str, at: int, tokens: str, offset: int, length: int) -> DataFrame:
    """The tokens of one row from an offset on: a filter on the key that the scan takes, and a slice."""
    return df.where(F.col(key) == at).select(key, F.slice(tokens, offset + 1, length).alias(tokens))
