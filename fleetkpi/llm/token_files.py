"""Token ids in binary files: one zstandard frame a document, a shared dictionary, an offset index.

A file holds, one after the other:
  magic TOKZDIC1; u32 length and JSON header (bytes an id, SHA-256 of the dictionary or null);
  one zstandard frame for each document; doc ids (i64), null marks (u8), ends of the frames in the
  file (u64), ids of each (u32); u64 place of that index, u64 documents, magic again.
The dictionary is trained on serialized id arrays and lies beside the files under its hash; too few or too
short documents to train on have none. A reader finds a document through the index and reads and
decompresses that frame alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, scratch_folder
from . import files
from .bpe import default_path, tokenizer

MAGIC = b"TOKZDIC1"
END_ID = 1
#: The dictionary is fitted on so many documents at most; a longer one gives so many slices of so many ids, from its
#: beginning to its end.
SAMPLE_DOCS, SLICES, SLICE_IDS, DICTIONARY_BYTES = 1000, 8, 2048, 65_536
#: Samples, and bytes of a dictionary, that training needs.
LEAST_SAMPLES, LEAST_BYTES = 8, 256
#: A file is closed when it holds so many bytes; so many stretches of words, and words of some, are remembered in a
#: Python worker.
FILE_BYTES, KNOWN_STRETCHES = 16 << 20, 500_000
MANIFEST = "file string, part bigint, roll bigint, n_docs bigint, n_ids bigint"


class _Words(dict):
    """Serialized ids of words."""

    def __init__(self, path: str, id_bytes: int):
        super().__init__()
        self.tok, self.code = tokenizer(path), {2: "H", 4: "I"}[id_bytes]

    def serialized(self, word: str) -> bytes:
        ids = self.tok.ids(word)
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, word: str) -> bytes:
        own = self[word] = self.serialized(word)
        return own


class _Known(dict):
    """Serialized ids of the stretches between white space seen so far."""

    def __init__(self, path: str, id_bytes: int):
        super().__init__()
        self.tok, self.words = tokenizer(path), _Words(path, id_bytes)

    def __missing__(self, stretch: str) -> bytes:
        if stretch.isascii() and stretch.isalpha():
            own = self.words.serialized(stretch)  # a word by itself
        else:
            own = b"".join(map(self.words.__getitem__, self.tok.within(stretch)))
        self[stretch] = own
        return own

    def ids(self, text: str, end: bytes) -> bytes:
        """Serialized ids of a text, then the end."""
        # words of stretches that are more than one word are the fewer
        for seen, most in ((self, KNOWN_STRETCHES), (self.words, KNOWN_STRETCHES // 2)):
            if len(seen) > most:
                seen.clear()
        parts = self.tok.stretches(text)
        if parts is None:
            return b"".join(chain(map(self.words.__getitem__, self.tok.words(text)), (end,)))
        return b"".join(chain(map(self.__getitem__, parts), (end,)))


@lru_cache(maxsize=1)
def _known(path: str, id_bytes: int) -> _Known:
    """Kept from task to task of a worker."""
    return _Known(path, id_bytes)


@dataclass
class TokenFiles:
    """Where the files are; `manifest` lists those that count, with the ids before each (`base`)."""

    folder: str
    dictionary: str | None
    manifest: DataFrame


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; empty where they are too few or too much alike to train on."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    if size < LEAST_BYTES or len(samples) < LEAST_SAMPLES:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError as error:
        warnings.warn(f"token files without a dictionary: {error}", stacklevel=2)
        return b""


def _sampled(ids: bytes, id_bytes: int) -> bytes:
    """A document's ids, or evenly spread slices of a long one."""
    n = len(ids) // id_bytes
    if n <= SLICES * SLICE_IDS:
        return ids
    starts = [i * (n - SLICE_IDS) // (SLICES - 1) for i in range(SLICES)]
    return b"".join(ids[a * id_bytes : (a + SLICE_IDS) * id_bytes] for a in starts)


def _compression(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int = END_ID) -> TokenFiles:
    """Encode docs (doc_id, text), add end_id to each and write all in ascending order of doc_id.

    Null texts count as empty; a row without doc_id comes first; rows with one doc_id follow each
    other in an order made from their texts. An empty table gives no files.
    """
    spark = docs.sparkSession
    path = path or default_path()
    folder = folder or scratch_folder(spark, "tokens")
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids = [*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"]), end_id]
    id_bytes = 2 if max(ids) < 1 << 16 else 4
    end = end_id.to_bytes(id_bytes, "little")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path, id_bytes)
        for batch in batches:
            out = [_sampled(known.ids(t.as_py(), end), id_bytes) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    # one text of each chosen id, the same in every run
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text").mapInArrow(ids_of, "ids binary")
    dictionary = _dictionary(sorted(bytes(r.ids) for r in sample.toLocalIterator()))
    digest = hashlib.sha256(dictionary).hexdigest() if _compression(dictionary) else None
    if digest:
        system, at = files.place(folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{digest}.zdict", compression=None) as out:
            out.write(dictionary)
    header = json.dumps({"id_bytes": id_bytes, "dictionary": digest}).encode()
    header = MAGIC + len(header).to_bytes(4, "little") + header

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path, id_bytes)
        press = zstandard.ZstdCompressor(level=3, dict_data=_compression(dictionary))
        part, roll = TaskContext.get().partitionId(), 0
        frames, own, ends, numbers, size = [header], [], [], [], len(header)

        def close() -> pa.RecordBatch:
            index = [
                np.array([d or 0 for d in own], "<i8").tobytes(),
                np.array([d is None for d in own], np.uint8).tobytes(),
                np.array(ends, "<u8").tobytes(),
                np.array(numbers, "<u4").tobytes(),
            ]
            foot = size.to_bytes(8, "little") + len(own).to_bytes(8, "little") + MAGIC
            name = files.write(folder, ".tok", [*frames, *index, foot])
            row = {"file": name, "part": part, "roll": roll, "n_docs": len(own), "n_ids": sum(numbers)}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = known.ids(text.as_py(), end)
                frames.append(press.compress(ids))
                size += len(frames[-1])
                own.append(doc_id)
                ends.append(size)
                numbers.append(len(ids) // id_bytes)
                if size > FILE_BYTES:
                    yield close()
                    frames, own, ends, numbers, size, roll = [header], [], [], [], len(header), roll + 1
        if own:
            yield close()

    # the text's hash cuts a doc_id that very many rows have
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    spread = docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    manifest = materialise(spread.mapInArrow(write, MANIFEST))
    # ids before a task's files, a row for each task, and within it before each file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("roll").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return TokenFiles(folder, digest, manifest.join(parts, "part").withColumn("base", base).drop("before"))


Read = Callable[[int, int], bytes]


def _index(read: Read, size: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Header, doc ids, null marks, edges of the frames and numbers of ids; `read` gives bytes at a place."""
    head, foot = read(0, 12), read(max(0, size - 24), 24)
    if head[:8] != MAGIC or foot[-8:] != MAGIC:
        raise ValueError("not a token file, or one that is cut off")
    length = int.from_bytes(head[8:12], "little")
    at, n = int.from_bytes(foot[:8], "little"), int.from_bytes(foot[8:16], "little")
    content = read(at, 21 * n)
    ids = np.frombuffer(content, "<i8", n)
    null = np.frombuffer(content, np.uint8, n, 8 * n).astype(bool)
    ends = np.frombuffer(content, "<u8", n, 9 * n).astype(np.int64)
    numbers = np.frombuffer(content, "<u4", n, 17 * n).astype(np.int64)
    return json.loads(read(12, length)), ids, null, np.concatenate(([12 + length], ends)), numbers


def _opener(head: dict, folder: str) -> Callable[[bytes], np.ndarray]:
    """What makes ids (u32) of a frame."""
    dictionary = files.read(folder, f"{head['dictionary']}.zdict") if head["dictionary"] else b""
    if dictionary and hashlib.sha256(dictionary).hexdigest() != head["dictionary"]:
        raise ValueError("the dictionary is not the one these files were written with")
    opened = zstandard.ZstdDecompressor(dict_data=_compression(dictionary))
    return lambda frame: np.frombuffer(opened.decompress(frame), f"<u{head['id_bytes']}").astype("<u4")


def read_document(folder: str, name: str, doc_id: int) -> list[int]:
    """Ids of one document of a file; only the index and its own frame are read."""
    with files.opened(folder, name) as file:
        head, ids, null, edges, _ = _index(lambda at, n: file.read_at(n, at), file.size())
        at = int(np.flatnonzero((ids == doc_id) & ~null)[0])
        frame = file.read_at(int(edges[at + 1] - edges[at]), int(edges[at]))
    return _opener(head, folder)(frame).tolist()


def read_tokens(spark, written: TokenFiles, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids on request.

    A document written without doc_id comes back without one, rows that repeat a doc_id one by one;
    no files give no rows.
    """
    folder = written.folder
    schema = "file string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                content = bytes(content)
                head, own, null, edges, numbers = _index(lambda at, n, c=content: c[at : at + n], len(content))
                opened = _opener(head, folder)
                crc, found = np.zeros(len(own), np.int64), []
                for i in range(len(own)):
                    ids = opened(content[edges[i] : edges[i + 1]])
                    if len(ids) != numbers[i]:
                        raise ValueError(f"{path}: document {own[i]} has not as many ids as its index says")
                    crc[i] = zlib.crc32(ids)
                    if with_ids:
                        found.append(ids.astype(np.int64))
                out = pd.DataFrame({"file": path.rsplit("/", 1)[-1], "doc_id": pd.array(own, "Int64")})
                out.loc[null, "doc_id"] = pd.NA
                out["inside"], out["n_tokens"], out["ids_crc32"] = np.cumsum(numbers) - numbers, numbers, crc
                yield out.assign(ids=found) if with_ids else out

    if not written.manifest.limit(1).count():
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.format("binaryFile").load(f"{folder}/*.tok").select("path", "content").mapInPandas(rows, schema)
    return found.join(written.manifest.select("file", "base"), "file").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), *found.columns[3:]
    )
