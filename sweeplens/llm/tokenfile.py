"""Token ids in files of independent zstandard frames with a seek table and checksums.

A file is a series of zstandard frames, each readable alone, then two
skippable frames: an index of documents (first document of each frame) and the
seek table of the public zstandard seekable format, with the low 32 bits of
XXH64 of each frame's content.  So a plain decoder reads the frames through,
and a reader that wants some documents fetches the two tables from the end,
then only the frames that hold them.

A frame's content: u32 number of segments; per segment the document id (i64),
whether it has one (u8), the place of its first id in the document (u64) and
its number of ids (u32); then all ids (u32).  Everything is little-endian.  A
document longer than a frame goes on in the next ones.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.llm import textarrays, tokens
from sweeplens.llm.shared import partitions, written
from sweeplens.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME_IDS = 1 << 17  # ids of a frame
LEVEL = 3
END_ID = 0
# fixed values of the seekable zstandard format
SKIPPABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_SKIPPABLE = 0x184D2A50  # another of the 16 skippable magic numbers: the index of documents

_SEGMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("first", "<u8"), ("n", "<u4")])
_INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("last_id", "<i8"), ("last_known", "u1")])
_SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
MANIFEST = "part int, path string, docs bigint, ids bigint, frames int"


class Writer:
    """Writes one file; documents come in the order they are to have."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        import zstandard

        self.stream, self.frame_ids = stream, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.segments: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.held = self.docs = self.total = 0
        self.index: list[tuple] = []
        self.seek: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while True:
            part = ids[at: at + self.frame_ids - self.held]
            self.segments.append((doc_id or 0, doc_id is not None, at, len(part)))
            self.ids.append(part)
            self.held += len(part)
            at += len(part)
            if self.held >= self.frame_ids:
                self._frame()
            if at >= len(ids):
                break
        self.docs += 1
        self.total += len(ids)

    def _frame(self) -> None:
        if not self.segments:
            return
        import xxhash

        table = np.array(self.segments, dtype=_SEGMENT)
        content = np.uint32(len(table)).tobytes() + table.tobytes() + np.concatenate(self.ids).astype("<u4").tobytes()
        packed = self.pack(content)
        self.stream.write(packed)
        self.seek.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.index.append((table["doc_id"][0], table["known"][0], table["doc_id"][-1], table["known"][-1]))
        self.segments, self.ids, self.held = [], [], 0

    def close(self) -> None:
        self._frame()
        index = np.array(self.index, dtype=_INDEX).tobytes()
        self.stream.write(np.array([INDEX_SKIPPABLE, len(index)], "<u4").tobytes() + index)
        seek = np.array(self.seek, dtype=_SEEK).tobytes()
        footer = np.uint32(len(self.seek)).tobytes() + bytes([CHECKSUM_FLAG]) + np.array([SEEK_MAGIC], "<u4").tobytes()
        self.stream.write(np.array([SKIPPABLE, len(seek) + len(footer)], "<u4").tobytes() + seek + footer)


class Reader:
    """Reads a file through its trailing tables; frames are decompressed one at a time when asked for."""

    def __init__(self, file):
        import zstandard

        self.file = file
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = file.size()
        frames, flag, magic = np.frombuffer(self._at(size - 9, 9), np.dtype([("n", "<u4"), ("flag", "u1"), ("magic", "<u4")]))[0]
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end")
        start = size - 9 - int(frames) * _SEEK.itemsize
        self.seek = np.frombuffer(self._at(start, int(frames) * _SEEK.itemsize), _SEEK)
        index_size = int(frames) * _INDEX.itemsize
        self.index = np.frombuffer(self._at(start - 8 - index_size, index_size), _INDEX)
        self.begin = np.concatenate(([0], np.cumsum(self.seek["packed"].astype(np.int64))))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments and ids of frame ``i``; raises when its checksum differs."""
        import xxhash

        content = self.unpack(self._at(int(self.begin[i]), int(self.seek["packed"][i])), max_output_size=int(self.seek["plain"][i]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.seek["checksum"][i]:
            raise ValueError(f"frame {i}: wrong checksum")
        n = int(np.frombuffer(content, "<u4", 1)[0])
        return np.frombuffer(content, _SEGMENT, n, 4), np.frombuffer(content, "<u4", offset=4 + n * _SEGMENT.itemsize)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id; only frames that can hold it are read."""
        found: list[list[np.ndarray]] = []
        able = (self.index["last_known"] == 1) & (self.index["last_id"] >= doc_id)
        able &= (self.index["known"] == 0) | (self.index["doc_id"] <= doc_id)
        for i in np.flatnonzero(able):
            segments, ids = self.frame(int(i))
            ends = np.cumsum(segments["n"].astype(np.int64))
            for s in np.flatnonzero((segments["doc_id"] == doc_id) & (segments["known"] == 1)):
                part = ids[ends[s] - segments["n"][s]: ends[s]]
                if segments["first"][s] == 0 and not (found and segments["n"][s] and not len(found[-1][0])):
                    found.append([part])
                else:
                    found[-1].append(part)
        return [np.concatenate(f) for f in found]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


def _write(folder: str, model, frame_ids: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        # an attempt's own name: only files that the committed manifest names are ever read
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer = stream = None
        encoder = tokens.encoder(model.value)
        for batch in batches:
            for a, b in textarrays.slices(batch.column(1), tokens.SLICE):
                if writer is None:
                    stream = files.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(stream, frame_ids, level)
                ids, first = encoder.encode(batch.column(1).slice(a, b - a))
                for i, doc_id in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    writer.add(doc_id, np.append(ids[first[i]: first[i + 1]], np.uint32(END_ID)))
        encoder.rest()
        if writer:
            writer.close()
            stream.close()
            row = (part, f"{folder}/{name}", writer.docs, writer.total, len(writer.seek))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()))],
                names=["part", "path", "docs", "ids", "frames"])

    return run


def write(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          folder: str | None = None, frame_ids: int = FRAME_IDS, level: int = LEVEL) -> DataFrame:
    """Encode whole texts, append the end id 0 to each and write them in ascending order of id.

    Returns the manifest, a written table: part, path, docs, ids, frames, with
    ``start``, the number of ids in the files before.  Files and manifest lie in
    ``folder``, by default a new one in the shared scratch folder; every file
    holds the next range of ids.  A null text is empty and has the end id
    alone; a null id comes first and is kept as null; repeated ids stay next to
    each other in the order of their texts; an empty table writes no file.
    Memory is bounded by a slice of texts and one frame.
    """
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    model = spark.sparkContext.broadcast(tokens.tokenizer_json(tokenizer))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(_write(folder, model, frame_ids, level), MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, path = _open(row["path"])
            with files.open_input_file(path) as file:
                reader = Reader(file)
                at, last = row["start"], None  # last: doc_id, start, ids, crc of the document being read
                for i in range(len(reader.seek)):
                    segments, ids = reader.frame(i)
                    raw, offset, out = memoryview(ids.tobytes()), 0, []
                    for doc_id, known, first, n in segments.tolist():
                        piece = raw[4 * offset: 4 * (offset + n)]
                        if first and last:
                            last = (*last[:2], last[2] + n, zlib.crc32(piece, last[3]))
                        else:
                            if last:
                                out.append(last)
                            last = (doc_id if known else None, at, n, zlib.crc32(piece))
                        offset += n
                        at += n
                    yield _rows(out)
                yield _rows([last] if last else [])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """Read every file of a manifest: doc_id, start, n_tokens, ids_crc32 of each document.

    Checks each frame's checksum; a file is one task's work, of which one frame
    is in memory at a time.
    """
    spread = manifest.select("part", "path", "start").repartition(partitions(manifest.sparkSession), "part")
    return spread.select("path", "start").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(path: str, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of some documents of one file, reading no more than its tables and the frames that hold them."""
    files, inner = _open(path)
    with files.open_input_file(inner) as file:
        reader = Reader(file)
        return {d: reader.document(d) for d in doc_ids}
