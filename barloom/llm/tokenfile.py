"""Token ids as flat binary files that can be memory-mapped.

A pair of files for each range of documents, in ascending order of the id: ``.u16`` (``.u32``
for vocabularies over 65,536) holds their token ids as flat unsigned integers, ``.off`` each
document's first token in that file as unsigned 64-bit integers, and one more for the end.
The index, a table, says which document is where. The manifest, a row per file, gives the
file's first token in the whole corpus: a prefix sum of the files' token counts.

Documents are ordered by a range exchange on (id, hash of text, place in the input), so an id that holds
a third of all rows is spread too; the files' order is that of the partitions. Null ids come first; null texts are
empty and hold the end token only. Repeated rows are written once each, in the order of
their input. An empty table gives an empty set. A task that is run again writes the same
bytes under its own attempt's name; the index names the files of the attempts that were committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_folder
from .common import keyed_texts, map_arrow


def open_folder(uri: str):
    """(file system, path) of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode and write; returns the written index: (_id, part, name, place, n_tokens), a row per document."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/barloom/tokens-{uuid.uuid4().hex}"
    kind = dict(docs.dtypes)[id_col]
    rows = keyed_texts(docs, id_col, text_col).withColumn("_place", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "_id", "_hash", "_place").sortWithinPartitions("_id", "_hash", "_place").select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .units import blocks, text_encoder

        encode, task, files = text_encoder(tokenizer), TaskContext.get(), None
        width = 2 if max(encode.vocab_size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        place = first = 0
        for batch in blocks(batches, "_text"):
            if files is None:
                fs, path = open_folder(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                files = [fs.open_output_stream(f"{path}.{x}") for x in (f"u{8 * width}", "off")]
            ids = [np.frombuffer(encode(x), "<u4").astype(f"<u{width}").tobytes() + end for x in batch.column("_text").to_pylist()]
            sizes = np.array([len(x) // width for x in ids], np.int64)
            files[0].write(b"".join(ids))
            files[1].write((first + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([task.partitionId()] * n, pa.int64()), pa.array([name] * n), pa.array([width] * n, pa.int32()), pa.array(np.arange(place, place + n)), pa.array(sizes)],
                ["_id", "part", "name", "width", "place", "n_tokens"])
            place, first = place + n, first + int(sizes.sum())
        if files:
            files[1].write(np.array([first], "<u8").tobytes())
            for f in files:
                f.close()

    schema = f"_id {kind}, part bigint, name string, width int, place bigint, n_tokens bigint"
    return materialize(map_arrow(ordered, run, schema, caches=True), "token-index")


def manifest(index: DataFrame) -> DataFrame:
    """A row per file: its documents and tokens, and its base: the tokens of all files before it."""
    sizes = index.groupBy("part", "name", "width").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint"))


def read(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document from the files; ids are little-endian unsigned 32-bit integers.

    The manifest that is broadcast has one row per file, which is one per task of the writer.
    """
    kind = dict(index.dtypes)["_id"]
    rows = index.select("_id", "part", "place").join(F.broadcast(manifest(index).select("part", "name", "width", "base")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import BLOCK_BYTES, binary_column

        opened = (None,)
        for batch in batches:
            names, widths = batch.column("name").to_pylist(), batch.column("width").to_numpy()
            places, bases = batch.column("place").to_numpy(), batch.column("base").to_numpy()
            lo, starts, sizes, ids, held = 0, [], [], [], 0
            for i, name in enumerate(names):
                if opened[0] != name:
                    opened = (name, _map(f"{name}.off", "<u8"), _map(f"{name}.u{8 * widths[i]}", f"<u{widths[i]}"))
                a, b = (int(x) for x in opened[1][places[i] : places[i] + 2])
                starts.append(int(bases[i]) + a)
                sizes.append(b - a)
                ids.append(opened[2][a:b].astype("<u4").tobytes())
                held += len(ids[-1])
                if held >= BLOCK_BYTES or i + 1 == len(names):
                    yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, i + 1 - lo), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), binary_column(ids)], ["_id", "start", "n_tokens", "ids"])
                    lo, starts, sizes, ids, held = i + 1, [], [], [], 0

    return map_arrow(rows, run, f"_id {kind}, start bigint, n_tokens bigint, ids binary").withColumnRenamed("_id", id_col)


def _map(name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped where it is local to the file system, else read."""
    from pyarrow import fs

    store, path = open_folder(name)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
