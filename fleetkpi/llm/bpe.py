"""BPE encoding over a table of distinct words, and decoding over the vocabulary.

Texts are cut into the words the tokenizer's pre-tokenizer would give it. A task numbers the words
of a chunk of texts and keeps each text as an array of these numbers. The words go to buckets by
hash, where each distinct word is encoded once, whichever and however many chunks have it, and its ids
return to the chunks by position in their word lists. Nothing but word lists and packed numbers moves;
no text does, and a frequent word is one entry for a chunk, not one for each time it occurs. Chunks and
word lists leave in one exchange that both sides of the join read, so each text is cut once.

Ids turn into text again by a join with the id-to-piece table on the map side. That table has one row
for each id of the vocabulary (its proven bound) and ids count from 0, so each Python worker holds it
as an array and the join of a list of ids is a gather at their positions, in their order.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of text whose words are numbered together.
CHUNK_CHARS = 2_000_000
#: Bytes of text for a bucket of words, about; its distinct words are together in one task.
BUCKET_BYTES = 64 << 20
#: `target` is the bucket of a word list; of a numbered chunk it is the chunk's key, which is below zero.
PACKED = "target bigint, chunk bigint, packed binary"

# Fixed values of this kind of tokenizer: the pattern of its words and its white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: The same pattern where all characters are ASCII and in lower case.
ASCII_PATTERN = r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Words of a text and ids of a word, as the tokenizers library finds them for this file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splits = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"]:
            raise ValueError("not a tokenizer of lower-cased words")
        self.model = Tokenizer.from_file(path).model
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        # str.split() takes these four for white space as well, the pattern does not
        self.separators = re.compile("[\x1c-\x1f]").search
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")").split
        self.bytes = {b: c for b, c in byte_characters().items()}
        self.marks = tuple(self.special)

    def words(self, text: str) -> list[str]:
        out: list[str] = []
        for part in self.cut(text) if self._marked(text) else [text]:
            out += [part] if part in self.special else self.within(self._normal(part))
        return out

    def stretches(self, text: str) -> list[str] | None:
        """The normalised text cut at white space, which no word reaches across; None if only `words` can cut it."""
        if self._marked(text):
            return None
        text = self._normal(text)
        return None if self.separators(text) else text.split()

    def within(self, stretch: str) -> list[str]:
        """Words of normalised text."""
        return (self.find_ascii if stretch.isascii() else self.find)(stretch)

    def _marked(self, text: str) -> bool:
        return any(mark in text for mark in self.marks)

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # one character at a time: a capital sigma has one small form
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        # printable ASCII characters stand for themselves
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(word)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=2)
def pieces(path: str) -> np.ndarray:
    """The piece of each id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    table = {i: piece for piece, i in spec["model"]["vocab"].items()} | {
        x["id"]: x["content"] for x in spec["added_tokens"]
    }
    out = np.empty(max(table) + 1, object)
    for i, piece in table.items():
        out[i] = piece
    return out


# ---------------------------------------------------------------- chunks of texts


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    body = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(body), *map(len, body)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(body))


def _unpack(packed: bytes) -> list[memoryview]:
    whole = memoryview(zstandard.ZstdDecompressor().decompress(packed))
    n = int(np.frombuffer(whole[:8], np.int64)[0])
    sizes = np.frombuffer(whole[8 : 8 * (n + 1)], np.int64).tolist()
    out, at = [], 8 * (n + 1)
    for size in sizes:
        out.append(whole[at : at + size])
        at += size
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of runs one after the other."""
    shift = np.cumsum(lengths)
    return np.repeat(starts - shift + lengths, lengths) + np.arange(shift[-1] if len(shift) else 0)


class _Chunk:
    """Texts whose words are numbered together."""

    def __init__(self, tok: WordTokenizer):
        self.tok, self.numbers, self.chars = tok, _Numbers(), 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.found: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        parts = self.tok.stretches(text)
        if parts is None:
            # a word by itself: no stretch begins with a space
            parts = [" " + word for word in self.tok.words(text)]
        self.ids.append(doc_id)
        self.counts.append(len(parts))
        self.found.append(np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts)))
        self.chars += len(text)

    def rows(self, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """Target, key and content: of the word list of each bucket, and of the numbered texts."""
        words = _Numbers()
        of = [[words[stretch[1:]]] if stretch[0] == " " else [words[w] for w in self.tok.within(stretch)] for stretch in self.numbers]
        lengths = np.fromiter(map(len, of), np.int64, len(of))
        flat = np.fromiter(chain.from_iterable(of), np.int64, int(lengths.sum()))
        stretches = np.concatenate(self.found)
        many = lengths[stretches]
        slots = flat[_spread((np.cumsum(lengths) - lengths)[stretches], many)]
        sums = np.concatenate(([0], np.cumsum(many)))
        edges = sums[np.concatenate(([0], np.cumsum(self.counts)))]
        # frequent words get small numbers, which pack well
        order = np.argsort(-np.bincount(slots, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        slots = rank[slots]
        listed = list(words)
        listed = [listed[i] for i in order]
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in listed), np.uint32, len(listed))
        lists = [(int(i), "\n".join(listed[j] for j in np.flatnonzero(bucket == i))) for i in np.unique(bucket)]
        sign = hashlib.blake2b(slots.tobytes(), digest_size=8)
        for _, own in lists:
            sign.update(own.encode())
        # made from the content, so that a chunk that is made again has the same
        key = -1 - (int.from_bytes(sign.digest(), "little") >> 1)
        for i, own in lists:
            yield i, key, _pack(own.encode())
        valid = np.array([x is not None for x in self.ids], bool)
        ids = np.array([x if x is not None else 0 for x in self.ids], np.int64)
        yield key, key, _pack(valid, ids, np.diff(edges), _planes(bucket), *_narrow(slots))


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The four bytes of all numbers apart, which packs better."""
    return numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()


#: Numbers below this take one byte; of the others that byte says which 65,536 they are in.
SMALL = 224


def _narrow(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mostly small numbers as one byte each and two more for the others; all as planes if one is too large."""
    above = numbers.astype(np.int64) - SMALL
    if len(above) and above.max() >= (256 - SMALL) << 16:
        return np.zeros(0, np.uint8), _planes(numbers)
    large = above >= 0
    first = np.where(large, SMALL + (above >> 16), numbers).astype(np.uint8)
    return first, (above[large] & 0xFFFF).astype(np.uint16).view(np.uint8).reshape(-1, 2).T.copy()


def _from_narrow(first: memoryview, more: memoryview) -> np.ndarray:
    if not len(first):
        return _from_planes(more)
    out = np.frombuffer(first, np.uint8).astype(np.int64)
    large = np.flatnonzero(out >= SMALL)
    rest = np.frombuffer(more, np.uint8).reshape(2, -1).T.copy().view(np.uint16).ravel()
    out[large] = SMALL + ((out[large] - SMALL) << 16) + rest
    return out


def _from_planes(packed: memoryview) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["target", "chunk", "packed"])


def _chunked(path: str, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        chunk = _Chunk(tok)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                chunk.add(doc_id, text.as_py() or "")
                if chunk.chars > CHUNK_CHARS:
                    yield _batch(list(chunk.rows(buckets)))
                    chunk = _Chunk(tok)
        if chunk.ids:
            yield _batch(list(chunk.rows(buckets)))

    return rows


def _encoded(path: str):
    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        """Ids of the words of a bucket, each encoded once, in the order of each chunk's list."""
        if rows.target.iloc[0] < 0:
            return rows[:0].rename(columns={"chunk": "bucket"})
        tok = tokenizer(path)
        known: dict[str, list[int]] = {}
        out = []
        for packed in rows.packed:
            words = bytes(_unpack(packed)[0]).decode().split("\n")
            ids = []
            for word in words:
                own = known.get(word)
                if own is None:
                    own = known[word] = tok.ids(word)
                ids.append(own)
            out.append(_ids_packed(ids))
        return pd.DataFrame({"target": rows.chunk, "bucket": rows.target, "packed": out})

    return encode


def _ids_packed(ids: list[list[int]]) -> bytes:
    lengths = np.array([len(x) for x in ids], np.uint32)
    return _pack(_planes(lengths), _planes(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))))


class Pieces:
    """The id-to-piece table of a tokenizer file."""

    def __init__(self, path: str):
        self.table = pieces(path)
        self.known = np.array([p is not None for p in self.table], bool)

    def text(self, ids: np.ndarray) -> str:
        """The pieces of ids, joined by spaces; what is no id of the vocabulary is left out."""
        fine = (ids >= 0) & (ids < len(self.table))
        if not fine.all() or not self.known[ids].all():
            ids = ids[fine]
            ids = ids[self.known[ids]]
        return " ".join(self.table[ids].tolist())


def _joined(path: str, decoded: bool):
    def join_back(numbered: pd.DataFrame, encoded: pd.DataFrame) -> pd.DataFrame:
        rows = _join_back(numbered, encoded)
        if decoded:
            table = Pieces(path)
            rows["decoded"] = pd.Series([table.text(ids) for ids in rows["ids"]], dtype=object)
        return rows

    return join_back


def _join_back(numbered: pd.DataFrame, encoded: pd.DataFrame) -> pd.DataFrame:
    """Ids of each text of a chunk, by the positions of its words in the lists of the buckets."""
    by_bucket = dict(zip(encoded.bucket, encoded.packed, strict=True))
    ids_out, docs_out = [], []
    for target, packed in zip(numbered.target, numbered.packed, strict=True):
        if target >= 0:  # a word list
            continue
        valid, own, counts, bucket, first, more = _unpack(packed)
        valid, own, counts = np.frombuffer(valid, bool), np.frombuffer(own, np.int64), np.frombuffer(counts, np.int64)
        bucket, slots = _from_planes(bucket), _from_narrow(first, more)
        lengths, starts = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        flat, at = [np.zeros(0, np.uint32)], 0
        for number in np.unique(bucket).tolist():
            n, ids = map(_from_planes, _unpack(by_bucket[number]))
            mine = np.flatnonzero(bucket == number)
            lengths[mine] = n
            starts[mine] = at + np.cumsum(n) - n
            flat.append(ids)
            at += len(ids)
        flat = np.concatenate(flat).astype(np.int32)
        ends = np.cumsum(counts)
        for doc, ok, a, b in zip(own.tolist(), valid.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            mine = slots[a:b]
            docs_out.append(doc if ok else None)
            ids_out.append(flat[_spread(starts[mine], lengths[mine])])
    return pd.DataFrame({"doc_id": pd.array(docs_out, "Int64"), "ids": pd.Series(ids_out, dtype=object)})


def encode(docs: DataFrame, path: str | None = None, buckets: int | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs (doc_id, text), without special tokens added.

    With `decoded` the ids are joined with their pieces again at once, in a column of that name as `decode`
    adds it, which saves the ids a second way through Python.

    A null or empty text has no ids. Strings of the special tokens inside a text become these
    tokens, as in the tokenizers library. Rows with equal or null doc_ids stay rows of their own. A table
    whose rows come in another order each time it is read should be written before: if a lost executor's
    part of it changed, its chunks would miss their words, which is an error.
    Other columns are ignored; an empty table gives an empty result.
    """
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    # both groupings are of the same rows by the same column, so that Spark makes and moves them once
    chunks = docs.mapInArrow(_chunked(path, buckets), PACKED).groupBy("target")
    encoded = chunks.applyInPandas(_encoded(path), "target bigint, bucket bigint, packed binary")
    kind = "doc_id bigint, ids array<int>" + ", decoded string" * decoded
    return chunks.cogroup(encoded.groupBy("target")).applyInPandas(_joined(path, decoded), kind)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encoded (ids array<int>) with `decoded`: the pieces of the ids, joined by spaces.

    The file names no decoder, and that is what the library's decode() does then, special tokens
    kept. A null list gives an empty text; an id outside the vocabulary is left out. A column that
    is called `decoded` already is replaced.
    """
    path = path or default_path()
    others = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*others)

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            out = [table.text(np.asarray(ids.values.fill_null(-1)) if ids.is_valid else np.zeros(0, np.int32)) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(pieces_of, schema)
