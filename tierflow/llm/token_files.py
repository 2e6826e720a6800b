"""Token ids in files of independent zstandard frames with a trailing seek table.

Format (public "seekable" layout): one frame per document holding its ids as
little-endian unsigned 32-bit integers; a frame with the documents' ids as
64-bit integers and, if any id is null, a bit per document that says which are
not; a skippable frame with, for every frame, compressed size, size
and the low 32 bits of the XXH64 of its content; a footer of frame count, a
descriptor byte (checksums present) and the magic number.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import dealt, new_folder, stored
from ._files import Whole, open_fs

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_U32 = np.dtype("<u4")


class FrameWriter:
    def __init__(self, folder: str, name: str, level: int = 3):
        self.file, self.pack = Whole(folder, name), zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.ids = [], []

    def _frame(self, data: bytes) -> None:
        frame = self.pack.compress(data)
        self.file.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc)
        self._frame(ids.astype(_U32).tobytes())

    def close(self) -> None:
        valid = np.array([i is not None for i in self.ids], bool)
        marks = b"" if valid.all() else np.packbits(valid, bitorder="little").tobytes()
        self._frame(np.array([i or 0 for i in self.ids], "<i8").tobytes() + marks)
        table = b"".join(self.table)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))
        self.file.close()


class FrameReader:
    """Reads the seek table, then only the frames asked for; each is checked against its checksum."""

    def __init__(self, uri: str):
        where, path = open_fs(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri}: no seek table")
        wide = 12 if flags & 0x80 else 8
        raw = np.frombuffer(self._at(size - 9 - n * wide, n * wide), _U32).reshape(n, wide // 4)
        self.sizes, self.lengths = raw[:, 0].astype(np.int64), raw[:, 1].astype(np.int64)
        self.sums = raw[:, 2] if wide == 12 else None
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.unpack = zstandard.ZstdDecompressor()
        ids = self.frame(n - 1)
        self.ids, marks = np.frombuffer(ids, "<i8", n - 1), np.frombuffer(ids, np.uint8, offset=8 * (n - 1))
        self.null = ~np.unpackbits(marks, count=n - 1, bitorder="little").astype(bool) if len(marks) else np.zeros(n - 1, bool)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        data = self.unpack.decompress(self._at(int(self.starts[i]), int(self.sizes[i])), max_output_size=int(self.lengths[i]))
        if self.sums is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i}: wrong checksum")
        return data

    def document(self, i: int) -> np.ndarray:
        return np.frombuffer(self.frame(i), _U32)


#: The normalizer, splits and model for which texts may be cut at white space.
_CHUNKED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "BPE", "</w>", None,
]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class CachedEncoder:
    """Whole texts to ids, with the ids of each white-space-free chunk remembered.

    The tokenizer drops white space before it merges, so a text's ids are those
    of its chunks one after the other. A chunk of letters and closing marks is
    looked up by its lower-case word, which the library's model encodes alone;
    any other chunk goes through the whole tokenizer. At most ``most`` chunks
    and as many words are remembered.
    """

    def __init__(self, path: str, most: int = 1_100_000):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tok.model, _byte_letters()
        conf = json.loads(self.tok.to_str())
        #: Other tokenizers may merge over white space or see chunks otherwise: whole texts go through them.
        self.whole = [conf["normalizer"], conf["pre_tokenizer"], conf["model"]["type"], conf["model"].get("end_of_word_suffix"), conf["model"].get("dropout")] != _CHUNKED
        self.simple = re.compile("([A-Za-z\u00df-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00de]+)([.,!?;:|#*$%&]*)").fullmatch
        self.odd = re.compile("[\x1c-\x1f]").search
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.words: dict[str, bytes] = {}
        self.flat, self.begin, self.size = bytearray(), array("q"), array("q")

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = self.words[word] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        m = self.simple(chunk)
        if not m:
            return array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()
        word, marks = m.groups()
        return self._word(word.lower()) + self._word(marks) if marks else self._word(word.lower())

    def _learn(self, chunks) -> None:
        for c in chunks:
            ids = self._chunk(c)
            self.known[c] = len(self.begin)
            self.begin.append(len(self.flat) // 4)
            self.size.append(len(ids) // 4)
            self.flat += ids

    def ids(self, text: str | None) -> np.ndarray:
        if text and (self.whole or self.odd(text)):  # white space to Python, not to the tokenizer
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, _U32)
        chunks = (text or "").split()
        if not chunks:
            return np.empty(0, _U32)
        k = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(k < 0)
        if len(miss):
            new = {chunks[i] for i in miss.tolist()}
            if len(self.known) + len(new) > self.most:
                self._clear()
                new, miss = set(chunks), np.arange(len(chunks))
            self._learn(new)
            k[miss] = [self.known[chunks[i]] for i in miss.tolist()]
        begin, all_sizes = np.frombuffer(self.begin, np.int64), np.frombuffer(self.size, np.int64)
        size = all_sizes[k]
        ends = np.cumsum(size)
        return np.frombuffer(self.flat, _U32)[np.arange(ends[-1]) + np.repeat(begin[k] - (ends - size), size)]


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One per Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", per_file: int = 8192) -> DataFrame:
    """Encode every text, write files in ascending id order and return ``(file, doc, n)`` of what was written.

    Rows are dealt by ranges of ids, so file ``i`` holds no larger ids than file
    ``i + 1``, and sorted within; a null text is empty, null ids come first, rows
    with one id follow each other in the order of a hash of their texts, and may
    lie in several files. An empty table writes no file.
    """
    from pyspark import TaskContext

    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def run(batches):
        out, part, seen, number = None, TaskContext.get().partitionId(), 0, 0
        for b in batches:
            names, docs_, sizes = [], [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                if out is not None and seen >= per_file:
                    out.close()
                    out, seen, number = None, 0, number + 1
                name = f"tokens-{part:06d}-{number:06d}.zst"
                out = out or FrameWriter(path, name)
                ids = encoder(tokenizer).ids(text)
                if end_id is not None:
                    ids = np.r_[ids, np.array([end_id], _U32)]
                out.add(doc, ids)
                seen += 1
                names.append(name), docs_.append(doc), sizes.append(len(ids))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(docs_, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "doc", "n"])
        if out is not None:
            out.close()

    src = src.withColumn("mark", F.xxhash64("text"))  # so that rows of one id, or none, are dealt out too
    return src.repartitionByRange("doc", "mark").sortWithinPartitions("doc", "mark").mapInArrow(run, "file string, doc bigint, n bigint")


def read_tokens(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """``(file, frame, doc, n_tokens, ids_crc32)`` of all documents in ``files`` (a column ``file``), read back frame by frame."""

    def run(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                r = FrameReader(f"{path}/{name}")
                for at in range(0, len(r.ids), 1000):
                    some = range(at, min(at + 1000, len(r.ids)))
                    data = [r.frame(i) for i in some]
                    yield pa.record_batch([
                        pa.array([name] * len(data)), pa.array(some, pa.int64()), pa.array(r.ids[at : at + 1000], mask=r.null[at : at + 1000]),
                        pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64()),
                    ], names=["file", "frame", "doc", "n_tokens", "ids_crc32"])

    return dealt(files.select("file").distinct(), "file").mapInArrow(run, "file string, frame bigint, doc bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", **how) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from files written and read back.

    ``start`` counts the ids of all documents before it: sums per file, then
    running sums over files and within each file. Rows are documents of their own,
    also where ids repeat or are null (those come first); null texts are empty, and
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    written = stored(write_tokens(docs, path, tokenizer, id_col=id_col, **how).groupBy("file").agg(F.sum("n").alias("n")), "files")
    files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = written.select("file", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    back = read_tokens(spark, path, written).withColumn("run", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, "file")
    return back.select(F.col("doc").alias(id_col), (F.col("base") + F.col("run")).cast("long").alias("start"), "n_tokens", "ids_crc32")
