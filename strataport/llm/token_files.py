"""Token ids in flat binary files with 64-bit document offsets.

A set of files is a folder in shared storage. Each partition of the documents, which are dealt by ranges of the id and
sorted within them, has three flat little-endian files:

    tokens-<name>.bin    ids of all its documents in a row, unsigned 16-bit where the vocabulary fits, else 32-bit
    offsets-<name>.bin   signed 64-bit, one more than documents: where each document starts in the tokens file
    ids-<name>.bin       signed 64-bit document ids (a null id as the least integer)

``index.json`` lists the partitions in order with their counts and bases. A base is the prefix sum of the counts before
it, so base + offset is a document's place in the whole corpus. A task writes files under a name of its own attempt and
only the names that committed tasks return are listed: a repeated or lost attempt leaves an unlisted file at worst.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, ship, written
from .tokens import default_path, encoder

NULL_ID = -(1 << 63)


def _fs(path: str):
    """File system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _save(folder: str, name: str, chunks) -> None:
    fs, base = _fs(folder)
    with fs.open_output_stream(f"{base}/{name}") as out:
        for c in chunks:
            out.write(c)


def _mapped(folder: str, name: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local, else read."""
    from pyarrow import fs as pafs

    fs, base = _fs(folder)
    path = f"{base}/{name}"
    if not fs.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class Part(NamedTuple):
    name: str
    documents: int
    tokens: int
    base_document: int
    base_token: int


class TokenFiles(NamedTuple):
    """A written set of files; ``parts`` are in ascending id order. Its size goes with the partitions, not with the
    documents."""

    folder: str
    dtype: str
    parts: list[Part]

    @classmethod
    def open(cls, folder: str) -> TokenFiles:
        fs, base = _fs(folder)
        with fs.open_input_file(f"{base}/index.json") as f:
            x = json.loads(f.read())
        return cls(folder, x["dtype"], [Part(**p) for p in x["parts"]])

    def read(self, spark: SparkSession, id_col: str = "doc_id") -> DataFrame:
        """Per document, from the files: id, start (ids of all documents before it), n_tokens and ids_crc32."""
        ship(spark)
        rows = [tuple(p) for p in self.parts]
        parts = spark.createDataFrame(rows, "name string, documents long, tokens long, base_document long, base_token long")
        parts = parts.repartition(max(1, len(rows)))
        return parts.mapInArrow(_Read(self.folder, self.dtype), "doc_id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc_id", id_col)


class _Write:
    def __init__(self, folder: str, tokenizer: str, end_id: int):
        self.folder, self.tokenizer, self.end_id = folder, tokenizer, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(self.tokenizer)
        end = np.array([self.end_id], enc.dtype).tobytes()
        name = uuid.uuid4().hex
        offsets, ids, total = [np.zeros(1, np.int64)], [], 0

        def tokens() -> Iterator[bytes]:
            nonlocal total
            for b in batches:
                ids.append(b.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                out = [enc.ids(t or "") + end for t in b.column("text").to_pylist()]
                size = np.array([len(x) for x in out], np.int64) // enc.dtype.itemsize
                offsets.append(total + np.cumsum(size))
                total = int(offsets[-1][-1]) if len(size) else total
                yield b"".join(out)

        _save(self.folder, f"tokens-{name}.bin", tokens())
        n = sum(map(len, ids))
        if n:
            _save(self.folder, f"offsets-{name}.bin", [x.astype("<i8").tobytes() for x in offsets])
            _save(self.folder, f"ids-{name}.bin", [x.tobytes() for x in ids])
            yield pa.RecordBatch.from_pydict({
                "partition": pa.array([TaskContext.get().partitionId()], pa.int64()), "name": [name], "documents": pa.array([n], pa.int64()),
                "tokens": pa.array([total], pa.int64()), "width": pa.array([enc.dtype.itemsize], pa.int32())
            })


class _Read:
    def __init__(self, folder: str, dtype: str):
        self.folder, self.dtype = folder, dtype

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                tokens = _mapped(self.folder, f"tokens-{r['name']}.bin", np.dtype(self.dtype))
                at = _mapped(self.folder, f"offsets-{r['name']}.bin", np.dtype("<i8"))
                ids = np.asarray(_mapped(self.folder, f"ids-{r['name']}.bin", np.dtype("<i8")))
                for i in range(0, len(ids), 10_000):
                    o = at[i : i + 10_001]
                    crc = [zlib.crc32(tokens[s:e].astype("<u4").tobytes()) for s, e in zip(o[:-1], o[1:])]
                    some = ids[i : i + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(some, pa.int64(), mask=some == NULL_ID), "start": pa.array(r["base_token"] + o[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(o), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())
                    })


def write_token_files(
    documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, folder: str | None = None,
) -> TokenFiles:
    """Encode every whole text and write the ids, with ``end_id`` after each document, in ascending id order.

    Null and empty texts have the end id alone; a null id comes first; rows of one id are ordered by a hash of their text
    (by which they are dealt to several tasks, if they are many) and by it, so content doesn't depend on the input's order. Only the id and text columns are read. An empty table gives an index
    without partitions.
    """
    spark = documents.sparkSession
    ship(spark)
    tokenizer = tokenizer or default_path()
    folder = folder or new_path(spark, "tokens")
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    df = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    dealt = df.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).repartitionByRange("id", "th").sortWithinPartitions("id", "th", "text").drop("th")
    index, _ = written(dealt.mapInArrow(_Write(folder, tokenizer, end_id), "partition long, name string, documents long, tokens long, width int"), "token-index")
    parts, doc, token, width = [], 0, 0, 2
    for r in sorted(index.collect(), key=lambda r: r.partition):  # a row for each partition
        parts.append(Part(r.name, r.documents, r.tokens, doc, token))
        doc, token, width = doc + r.documents, token + r.tokens, r.width
    dtype = f"<u{width}"
    _save(folder, "index.json", [json.dumps({"dtype": dtype, "parts": [p._asdict() for p in parts]}).encode()])
    return TokenFiles(folder, dtype, parts)
