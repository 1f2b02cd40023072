"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

Data file: one frame per document, in ascending order of the id column. A frame is

    uint64 length | uint32 masked crc32c(length) | payload | uint32 masked crc32c(payload)

and its payload is ``uint32 bytes of the key (2**32 - 1: null) | key as UTF-8 | uint32 ids | ids``, the
ids packed as uint16 (uint32 for vocabularies past 65,536) and compressed. Index file: per frame
``uint64 offset | uint64 frame bytes | uint32 ids``, so that a reader can fetch frames in any order. All numbers are little-endian.

Each task writes one file under a name of its own and returns a line for the manifest. Only lines of tasks
that succeed reach the manifest, so a repeated or speculative task leaves a file nobody reads.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strandwise.llm.columns import give_back
from strandwise.llm.crc32c import crc32c, masked
from strandwise.session import scratch_path, stage

VOCABULARY = "word_bpe_49k.json"
END = 1
NULL = 2**32 - 1
CACHED_WORDS = 3 << 17  # a worker's memory of encoded words and pieces; emptied when full
ROWS = 256
INDEX = np.dtype([("offset", "<u8"), ("size", "<u8"), ("ids", "<u4")])
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
DECODED = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("before", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Texts to ids as little-endian bytes.

    This tokenizer drops white space before it splits, so a text's ids are those of its pieces between
    spaces and line ends, one after the other; pieces seen before are not encoded again. A piece of
    Latin letters, with or without one mark behind, is split as the tokenizer would and goes straight to
    its model; any other piece goes through the whole tokenizer. A word without its mark, in small letters,
    is a piece too, so both are kept in one place.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        rest = []
        for piece in set().union(*pieces).difference(known):
            got = self._letters(piece)
            if got is None:
                rest.append(piece)
            else:
                known[piece] = got
        for piece, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[piece] = self._packed(got.ids)
        end = self._packed([END])
        return [b"".join([*map(known.__getitem__, p), end]) for p in pieces]

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _letters(self, piece: str) -> bytes | None:
        low = piece.lower()
        word, mark = (low[:-1], low[-1]) if low and low[-1] in MARKS else (low, "")
        if not word.isalpha() or not word.isascii() and (max(word) >= BEYOND_LATIN or not is_normalized("NFC", word)):
            return None
        return self._part(word, self.known) + (self._part(mark, self.marks) if mark else b"")

    def _part(self, part: str, kept: dict[str, bytes]) -> bytes:
        got = kept.get(part)
        if got is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_byte_letters())
            got = kept[part] = self._packed([t.id for t in self.model.tokenize(spelled)])
        return got


MARKS = ",.!?;:"
BEYOND_LATIN = "\u0250"


@cache
def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies spell a byte as its Latin-1 character, or one past 255 where that does not print."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(printed)))}


@cache
def encoder(vocabulary: str) -> Encoder:
    """One encoder for all writing tasks that a Python worker runs, with the pieces it knows."""
    return Encoder(vocabulary)


def _frames(keys: list[str | None], ids: list[bytes], width: int, squeeze: zstandard.ZstdCompressor) -> list[bytes]:
    payloads = []
    for key, body in zip(keys, ids):
        name = b"" if key is None else key.encode()
        head = np.array([NULL if key is None else len(name)], dtype="<u4").tobytes() + name
        payloads.append(head + np.array([len(body) // width], dtype="<u4").tobytes() + squeeze.compress(body))
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    marks = masked(crc32c(lengths + payloads)).astype("<u4")
    n = len(payloads)
    return [lengths[i] + marks[i].tobytes() + payloads[i] + marks[n + i].tobytes() for i in range(n)]


def write_records(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
) -> DataFrame:
    """Encode, frame and write ``docs`` under ``path``; returns the manifest, one row per file.

    Documents are range-partitioned and sorted by ``doc_id`` (null first, then by text), so files are in
    ascending order of ``shard`` and frames ascending within. Null and empty texts hold the end id alone;
    repeated ids and rows are written as often as they come; other columns are ignored. An empty table
    writes no file.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text").select(
        F.spark_partition_id().alias("shard"), F.col("id").cast("string").alias("key"), "text"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shard, sink = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if sink is None:
                    shard, sink = part.column("shard")[0].as_py(), _Sink(path, vocabulary)
                sink.add(part.column("key").to_pylist(), part.column("text").to_pylist())
        if sink is not None:
            yield pa.RecordBatch.from_pylist([{"shard": shard, **sink.close()}], schema=_MANIFEST)

    return stage(ordered.mapInArrow(run, MANIFEST), "records-manifest")


_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


class _Sink:
    """One data file and its index, written as the task goes."""

    def __init__(self, path: str, vocabulary: str):
        self.encode = encoder(vocabulary)
        self.width = np.dtype(self.encode.kind).itemsize
        self.squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
        self.name = os.path.join(path, f"records-{uuid.uuid4().hex}")
        self.store, self.base = filesystem(self.name)
        self.store.create_dir(os.path.dirname(self.base), recursive=True)
        self.out = self.store.open_output_stream(self.base + ".bin")
        self.entries: list[np.ndarray] = []
        self.at = self.tokens = self.docs = 0

    def add(self, keys: list[str | None], texts: list[str | None]) -> None:
        ids = self.encode([t or "" for t in texts])
        frames = _frames(keys, ids, self.width, self.squeeze)
        entry = np.zeros(len(frames), dtype=INDEX)
        entry["size"] = [len(f) for f in frames]
        entry["offset"] = self.at + np.cumsum(entry["size"]) - entry["size"]
        entry["ids"] = [len(i) // self.width for i in ids]
        self.out.write(b"".join(frames))
        self.entries.append(entry)
        self.at += int(entry["size"].sum())
        self.tokens += int(entry["ids"].sum())
        self.docs += len(frames)

    def close(self) -> dict:
        self.out.close()
        with self.store.open_output_stream(self.base + ".idx") as out:
            out.write(np.concatenate(self.entries).tobytes())
        return {"path": self.name, "n_docs": self.docs, "n_tokens": self.tokens, "n_bytes": self.at}


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it for a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


class Shard:
    """Frames of one file in any order, through its index; checksums are compared on the way."""

    def __init__(self, path: str, width: int):
        self.store, self.base = filesystem(path)
        with self.store.open_input_stream(self.base + ".idx") as f:
            self.index = np.frombuffer(f.read(), dtype=INDEX)
        self.file = self.store.open_input_file(self.base + ".bin")
        self.kind = f"<u{width}"
        self.expand = zstandard.ZstdDecompressor()

    def read(self, first: int, last: int) -> list[tuple[str | None, np.ndarray]]:
        """Keys and ids of the frames from ``first`` up to ``last``, end exclusive."""
        index = self.index[first:last]
        if not len(index):
            return []
        start = int(index["offset"][0])
        self.file.seek(start)
        data = self.file.read(int(index["offset"][-1] + index["size"][-1]) - start)
        frames = [data[o : o + n] for o, n in zip((index["offset"] - start).tolist(), index["size"].tolist())]
        lengths, payloads = [f[:8] for f in frames], [f[12:-4] for f in frames]
        stored = np.frombuffer(b"".join(f[8:12] for f in frames) + b"".join(f[-4:] for f in frames), dtype="<u4")
        whole = all(int.from_bytes(n, "little") == len(p) for n, p in zip(lengths, payloads))
        if not whole or not np.array_equal(masked(crc32c(lengths + payloads)), stored):
            raise OSError(f"damaged records in {self.base}.bin between frames {first} and {last}")
        return [self._sequence(p) for p in payloads]

    def _sequence(self, payload: bytes) -> tuple[str | None, np.ndarray]:
        size = int.from_bytes(payload[:4], "little")
        at = 4 if size == NULL else 4 + size
        key = None if size == NULL else payload[4:at].decode()
        n = int.from_bytes(payload[at : at + 4], "little")
        ids = np.frombuffer(self.expand.decompress(payload[at + 4 :]), dtype=self.kind)
        if len(ids) != n:
            raise OSError(f"a record of {self.base}.bin holds {len(ids)} ids, not {n}")
        return key, ids


def read_records(manifest: DataFrame, width: int = 2) -> DataFrame:
    """Frame by frame from the files: ``key``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all frames before this one in all files: a running sum over the
    manifest (one row per file) gives each file's, the index each frame's.
    """
    ahead = F.coalesce(
        F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    files = stage(manifest.select("shard", "path", ahead.alias("ahead")), "records-files")
    n_files = files.count()
    if n_files > 1:
        files = files.repartition(n_files, "path")
    decoded = files.mapInArrow(_decoder(width), DECODED)
    return decoded.select("key", F.col("before").alias("start"), "n_tokens", "ids_crc32")


def _decoder(width: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # files are read when all are written; the worker goes on without its pieces
        give_back()
        for batch in batches:
            for row in batch.to_pylist():
                shard, before = Shard(row["path"], width), row["ahead"]
                for at in range(0, len(shard.index), ROWS):
                    rows = []
                    for key, ids in shard.read(at, at + ROWS):
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append({"key": key, "shard": row["shard"], "before": before, "n_tokens": len(ids), "ids_crc32": crc})
                        before += len(ids)
                    yield pa.RecordBatch.from_pylist(rows, schema=_DECODED)

    return run


_DECODED = pa.schema([("key", pa.string()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def new_folder(docs: DataFrame) -> str:
    """A fresh folder for records in the shared folder of the session."""
    return scratch_path(docs.sparkSession, "records")
