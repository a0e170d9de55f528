"""Token ids of documents in sorted-string-table shards, in ascending doc_id order over all shards.

Texts are dealt by ranges of doc_id, sorted, encoded and written, a shard or more a
task; a task names its files with a fresh suffix and reports them when they are
complete, so what a lost or repeated task leaves behind is in no manifest. The
manifest (a row a shard) is all that reaches the driver.

Defined results: null and empty texts hold the end token alone; a null doc_id comes
first; repeated doc_id values are kept, ordered by text; an empty table gives no shard
and no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, doc_texts, new_path
from .encoder import default_tokenizer, encoder, slices
from .sstable import Reader, Writer, key_of

_MANIFEST = "path string, size long, entries long, tokens long, first_key binary, last_key binary"


def file_system(uri: str):
    """(pyarrow file system, path) for a folder URI: local and the stores that pyarrow opens (hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class TokenShards:
    """shard_bytes: a shard is closed at about this many bytes of ids."""

    tokenizer: str | None = None
    end_id: int = 1
    shard_bytes: int = 256 << 20

    def write(self, documents: DataFrame, folder: str) -> list[dict]:
        """Write all documents below `folder`; the manifest in key order, with the tokens before each shard."""
        path, end, most = self.tokenizer or default_tokenizer(), self.end_id, self.shard_bytes

        def run(batches):
            import numpy as np

            store, root = file_system(folder)
            store.create_dir(root, recursive=True)
            enc, tail = encoder(path), end.to_bytes(4, "little")
            width = 2 if max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else 4
            writer = out = name = None
            done = []

            def close():
                size = writer.finish()
                out.close()
                done.append((f"{folder}/{name}", size, writer.entries, writer.tokens, writer.first, writer.last))

            for batch in batches:
                keys, texts = column(batch, "doc_id"), column(batch, "text")
                for i, j in slices(texts):
                    for key, ids in zip(keys[i:j], enc.encode(texts[i:j]), strict=True):
                        if writer is None:
                            name = f"shard-{uuid.uuid4().hex}.sst"
                            out = store.open_output_stream(f"{root}/{name}")
                            writer = Writer(out, width)
                        writer.add(key_of(key), np.frombuffer(ids + tail, "<u4"))
                        if width * (writer.tokens + writer.block_tokens) >= most:
                            close()
                            writer = None
            if writer is not None:
                close()
            if done:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["path", "size", "entries", "tokens", "first_key", "last_key"])

        dealt = doc_texts(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        # shards of one range follow each other, and ranges do not overlap
        rows = [r.asDict() for r in dealt.mapInArrow(run, _MANIFEST).collect()]
        before = 0
        for r in rows:
            r["before"] = before
            before += r["tokens"]
        return rows

    def read(self, spark: SparkSession, manifest: list[dict]) -> DataFrame:
        """Every entry of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"

        def run(batches):
            for batch in batches:
                for path, size, before in zip(column(batch, "path"), column(batch, "size"), column(batch, "before"), strict=True):
                    store, name = file_system(path)
                    with store.open_input_file(name) as f:
                        start, rows = before, []
                        for key, ids in Reader(f, size):
                            rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path))
                            start += len(ids)
                            if len(rows) == 10_000:
                                yield _batch(rows)
                                rows = []
                    if rows:
                        yield _batch(rows)

        names = spark.createDataFrame([(r["path"], r["size"], r["before"]) for r in manifest], "path string, size long, before long")
        return names.repartition(max(1, len(manifest))).mapInArrow(run, schema)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def lookup(manifest: list[dict], doc_id: int | None) -> list:
    """The ids of a document: by the shards' key ranges, then filter, index and block of the shard."""
    key, found = key_of(doc_id), []
    for r in manifest:
        if r["first_key"] <= key <= r["last_key"]:
            store, name = file_system(r["path"])
            with store.open_input_file(name) as f:
                found += Reader(f, r["size"]).get(doc_id)
    return found


def write_and_read(documents: DataFrame, **options) -> DataFrame:
    shards = TokenShards(**options)
    return shards.read(documents.sparkSession, shards.write(documents, new_path(documents.sparkSession, "shards")))
