"""SentencePiece encoding and decoding by a relational lattice over distinct words."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import new_folder, new_name, numbered
from ._files import open_fs

SPACE = "▁"
#: Longest word whose boundaries fit the bits of a long.
BITS = 62
#: Characters below this code have their ids in a small array, the others are edges of the lattice.
LOW = 0x250


@dataclass
class Pieces:
    """What a model file holds, and where a text may be cut without changing its pieces."""

    path: str
    rows: list[tuple[str, int, int]] = field(default_factory=list)  # piece, id, rank
    scores: dict[int, float] = field(default_factory=dict)
    table: list[bytes] = field(default_factory=list)
    byte0: int = 3

    def __post_init__(self):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = m.get_piece_size()
        self.byte0 = next(i for i in range(n) if m.is_byte(i))
        normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.scores = {i: m.get_score(i) for i in normal}
        order = sorted(set(self.scores.values()), reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        #: Whole numbers as scores, which only order the merges, belong to a BPE model, others to a unigram model.
        self.merges = all(s == int(s) for s in order)
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.table.append(bytes([int(p[3:5], 16)]))
            elif i in self.scores:
                p = p.replace(SPACE, " ")
                self.table.append(p.encode())
                self.rows.append((p, i, rank[self.scores[i]]))
            else:
                self.table.append(b"")
        pairs = {p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}
        chars = sorted({c for p in pairs for c in p})
        kinds = len(chars) + 1
        self._kind = np.zeros(0x110000, np.uint16)
        self._kind[[ord(c) for c in chars]] = np.arange(1, kinds)
        joined = np.zeros((kinds, kinds), bool)
        for a, b in pairs:
            joined[self._kind[ord(a)], self._kind[ord(b)]] = True
        self._joined, self._kinds = joined.ravel(), kinds

    def units(self, texts: list[str | None]) -> tuple[pa.StringArray, np.ndarray]:
        """(words of all texts, where each text's end): a word ends where no piece holds the next two characters."""
        parts = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        flat, ends = "".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        if not flat:
            return pa.array([], pa.string()), ends
        code = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        kind = self._kind[code].astype(np.int32)
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self._joined[kind[:-1] * self._kinds + kind[1:]]
        cut[ends] = True
        at, data = np.flatnonzero(cut), flat.encode()
        place = at
        if len(data) != len(code):
            wide = 1 + (code >= 0x80).view(np.uint8) + (code >= 0x800).view(np.uint8) + (code >= 0x10000).view(np.uint8)
            place = np.r_[np.int32(0), np.cumsum(wide, dtype=np.int32)][at]
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data))
        return words, np.searchsorted(at, ends)

    def late(self) -> set[str]:
        """Pieces whose own merges don't come in rank order, or don't end in the piece.

        Merges inside a span that no merge crosses go as they go in the span alone,
        so words without such pieces are merged in rank order.
        """
        rank, out = {p: r for p, _, r in self.rows}, set()
        for p, r in rank.items():
            parts, last = list(p), -1
            while len(parts) > 1:
                best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
                if best is None or best[0] < last:
                    break
                last, i = best
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) > 1 or last > r:
                out.add(p)
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per process."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def piece_table(spark: SparkSession, rows: list[tuple[str, int, int]], late: set[str] = frozenset()) -> DataFrame:
    return spark.createDataFrame([(a, i, r, a in late) for a, i, r in rows], "piece string, id int, rank int, late boolean")


# An edge as one long that sorts by rank and place: rank, id + 1, start, length.
_PLACE, _ID = "cast(x & 4095 as int)", "(shiftright(x, 12) & 1048575)"


def _spans() -> tuple[list[int], list[int]]:
    """By an edge's place (start * 64 + length): the bits of its two ends, and of the boundaries between."""
    ends, inner = [0] * 4096, [0] * 4096
    for s in range(BITS):
        for n in range(1, BITS - s + 1):
            ends[s * 64 + n] = (1 << s) | (1 << (s + n))
            inner[s * 64 + n] = (1 << (s + n)) - (1 << (s + 1))
    return ends, inner


def lattice(units: DataFrame, table: DataFrame, singles: int = 0) -> DataFrame:
    """``(unit, edges, late)``: for every distinct word its substrings that are pieces.

    The substrings from each place are as long as the longest piece that starts
    with the same three characters, and are joined to the piece table. Of single
    characters only those of code ``singles`` and above are edges, with id 0 if
    they are no pieces. ``units`` are spread by ``unit``, so the substrings of a
    word meet again without a shuffle.
    """
    three = table.where("length(piece) > 2").groupBy(F.xxhash64(F.substring("piece", 1, 3)).alias("start")).agg(F.max(F.length("piece")).alias("most"))
    at = units.select("unit", F.explode(F.expr("sequence(0, greatest(0, length(unit) - 1))")).alias("s"))
    # a vocabulary has a fixed size
    at = at.join(F.broadcast(three), F.xxhash64(F.expr("substring(unit, s + 1, 3)")) == F.col("start"), "left")
    first = f"if(ascii(substring(unit, s + 1, 1)) >= {singles}, 1, 2)" if singles else "1"
    sub = at.select("unit", "s", F.explode(F.expr(f"sequence({first}, greatest(2, least(coalesce(most, 2), length(unit) - s)))")).alias("l"))
    sub = sub.withColumn("part", F.expr("substring(unit, s + 1, l)"))
    known = table.select(
        F.xxhash64("piece").alias("key"), "piece", F.octet_length("piece").alias("bytes"), F.length("piece").alias("chars"), "late",
        F.expr("(cast(rank as bigint) << 32) | ((cast(id as bigint) + 1) << 12)").alias("entry"),
    )
    # The join's key is one long; equal text is checked beside it.
    same = F.expr("l = chars and startswith(part, piece) and bytes = octet_length(part)")
    hit = sub.join(F.broadcast(known), (F.xxhash64("part") == F.col("key")) & same, "left").where("entry is not null or l = 1 or (s = 0 and l = 2)")
    code = F.expr("case when entry is not null then entry | (s * 64 + l) when l = 1 then (1048575L << 32) | (s * 64 + l) end")
    late = F.max(F.coalesce("late", F.lit(False))).alias("late")
    return hit.groupBy("unit").agg(F.sort_array(F.collect_list(code)).alias("edges"), late)


def fold_merges(edges: DataFrame, byte0: int, low: list[int] = (), late: bool = True) -> DataFrame:
    """``(unit, ids)``: boundaries folded away in the order of the merges' ranks.

    An edge applies if its ends are boundaries and one boundary lies between.
    Where merges come in rank order one fold over the sorted edges is exact.
    Else (``late``) every step of the fold looks for the first edge that applies.
    ``low`` has id + 1 of single characters that are no edges, by their code; what
    is no piece becomes bytes.
    """
    at = F.col("edges")
    ends, inner = map(F.lit, _spans())

    def place(x):
        return x.bitwiseAND(4095).cast("int")

    def fits(m, x):
        e, i = ends[place(x)], inner[place(x)]
        return (m.bitwiseAND(e) == e) & (F.bit_count(m.bitwiseAND(i)) == 1)

    start = F.expr("shiftleft(1L, length(unit) + 1) - 1")
    once = F.aggregate(at, start, lambda m, x: F.when(fits(m, x), m.bitwiseAND(F.bitwise_not(inner[place(x)]))).otherwise(m))
    if late:
        step = lambda m, _: F.coalesce(m.bitwiseAND(F.bitwise_not(inner[place(F.get(F.filter(at, lambda x: fits(m, x)), F.lit(0)))])), m)
        once = F.when(F.col("late"), F.aggregate(F.sequence(F.lit(1), F.length("unit")), start, step)).otherwise(once)
    out = edges.withColumn("m", once)
    m = F.col("m")
    left = F.filter(at, lambda x: (m.bitwiseAND(ends[place(x)]) == ends[place(x)]) & (m.bitwiseAND(inner[place(x)]) == 0))
    left = F.transform(left, lambda x: F.shiftleft(x.bitwiseAND(4095), 20).bitwiseOR(F.shiftright(x, 12).bitwiseAND(1048575)))
    if len(low):
        table = F.lit(list(low))
        char = lambda p: F.ascii(F.substring(F.col("unit"), p + 1, F.lit(1)))
        alone = F.filter(F.expr("sequence(0, length(unit) - 1)"), lambda p: (F.call_function("shiftright", m, p).bitwiseAND(3) == 3) & (char(p) < len(low)))
        alone = F.transform(alone, lambda p: F.shiftleft((p * 64 + 1).cast("long"), 20).bitwiseOR(table[char(p)].cast("long")))
        left = F.when(m.bitwiseAND(F.shiftright(m, 1)) == 0, left).otherwise(F.concat(left, alone))
    part = out.select("unit", F.sort_array(left).alias("t"))  # what is left of an edge sorts by its start
    raw = "encode(substring(unit, cast(shiftright(x, 26) as int) + 1, 1), 'utf-8')"
    split = f"flatten(transform(t, x -> if((x & 1048575) > 0, array(cast((x & 1048575) - 1 as int)), transform(sequence(1, octet_length({raw})), k -> cast(conv(hex(substring({raw}, k, 1)), 16, 10) as int) + {byte0}))))"
    ids = F.expr(f"if(exists(t, x -> (x & 1048575) = 0), {split}, transform(t, x -> cast((x & 1048575) - 1 as int)))")
    return part.select("unit", ids.alias("ids"))


def fold_viterbi(edges: DataFrame, scores: dict[int, float], unknown: float = -100.0) -> DataFrame:
    """``(unit, ids)`` of the path with the highest sum of scores, for unigram models.

    The fold goes over edges by their end and keeps, per boundary, the best
    score and the path to it; a character that is no piece has id -1.
    """
    score = F.create_map(*[F.lit(x) for kv in {**scores, -1: unknown}.items() for x in kv])
    start = "cast(shiftright(x & 4095, 6) as int)"
    e = edges.select("unit", F.expr(f"array_sort(transform(edges, x -> struct({start} + cast(x & 63 as int) as e, {start} as s, cast({_ID} - 1 as int) as id)))").alias("edges"))
    e = e.withColumn("edges", F.transform("edges", lambda x: F.struct(x.e.alias("e"), x.s.alias("s"), x.id.alias("id"), score[x.id].cast("double").alias("w"))))
    best = "aggregate(edges, array(struct(0D as w, cast(array() as array<int>) as path)), (a, x) -> if(size(a) <= x.e, concat(a, array(struct(a[x.s].w + x.w as w, concat(a[x.s].path, array(x.id)) as path))), if(a[x.e].w < a[x.s].w + x.w, transform(a, (v, i) -> if(i = x.e, struct(a[x.s].w + x.w as w, concat(a[x.s].path, array(x.id)) as path), v)), a)))"
    return e.select("unit", F.expr(f"element_at({best}, -1).path").alias("ids"))


def merge_long(unit: str, rank: dict[str, tuple[int, int]], byte0: int) -> list[int]:
    """The same merges for a word too long for the fold, by a heap of pairs."""
    import heapq

    text, left, right = list(unit), list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
    heap: list[tuple[int, int, str]] = []

    def push(i: int) -> None:
        j = right[i]
        if j < len(text) and (r := rank.get(text[i] + text[j])):
            heapq.heappush(heap, (r[0], i, text[i] + text[j]))

    for i in range(len(text)):
        push(i)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = right[i] if text[i] else len(text)
        if not text[i] or j >= len(text) or text[i] + text[j] != whole:
            continue
        text[i], text[j], right[i] = whole, "", right[j]
        if right[j] < len(text):
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [x for t in text if t for x in ([rank[t][1]] if t in rank else [b + byte0 for b in t.encode("utf-8", "replace")])]


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """``(unit, ids)`` of distinct words of at most 62 characters, which are spread by ``unit``."""
    p = pieces(path)
    if not p.merges:
        return fold_viterbi(lattice(units, piece_table(units.sparkSession, p.rows)), p.scores)
    late, low = p.late(), [0] * LOW
    for a, i, _ in p.rows:
        if len(a) == 1 and ord(a) < LOW:
            low[ord(a)] = i + 1
    table = piece_table(units.sparkSession, p.rows, late)
    return fold_merges(lattice(units, table, LOW), p.byte0, low, bool(late))


def _encode_long(path: str):
    def run(batches):
        p = pieces(path)
        rank = {a: (r, i) for a, i, r in p.rows}
        for b in batches:
            ids = [merge_long(u, rank, p.byte0) for u in b.column("unit").to_pylist()]
            yield pa.record_batch([b.column("chunk"), b.column("unit"), pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "unit", "ids"])

    return run


def _slices(batch: pa.RecordBatch, bits: int = 19):
    """Consecutive rows of one chunk with about 2 ** ``bits`` bytes of text: (chunk, rows)."""
    chunk = batch.column("chunk").to_numpy()
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (np.diff(np.cumsum(size) >> bits) > 0)]) if len(chunk) else []
    for i, j in zip(at, [*at[1:], len(chunk)]):
        yield chunk[i], batch.slice(i, j - i)


def _distinct(path: str, most: int = 1_000_000):
    """Distinct words of consecutive rows of one chunk; a word may come again after ``most`` others."""

    def run(batches):
        p, chunk, seen = pieces(path), None, []

        def flush():
            words = pc.unique(pa.concat_arrays(seen))
            return pa.record_batch([pa.array(np.full(len(words), chunk), pa.int64()), words], names=["chunk", "unit"])

        for key, rows in (x for b in batches for x in _slices(b)):
            if seen and (key != chunk or len(seen[0]) > most):
                yield flush()
                seen = []
            chunk = key
            seen.append(pc.unique(p.units(rows.column("text").to_pylist())[0]))
            if sum(map(len, seen[1:])) > len(seen[0]):
                seen = [pc.unique(pa.concat_arrays(seen))]
        if seen:
            yield flush()
        pa.default_memory_pool().release_unused()

    return run


def write_dictionaries(src: DataFrame, path: str) -> str:
    """Encode the distinct words of all texts by the lattice; the folder has a file of words and ids for each chunk.

    ``src`` has ``chunk`` and ``text``. A table bucketed by word, in the shared folder, holds the words
    of every chunk, so that distinct words, their lattices and the way back to
    the chunks need no shuffle of their own. Words of more than 62 characters
    are merged by a heap.
    """
    spark = src.sparkSession
    spread = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, folder = f"units_{uuid.uuid4().hex}", new_folder(spark, "dictionaries")
    words = src.select("chunk", "text").mapInArrow(_distinct(path), "chunk bigint, unit string").repartition(spread, "unit").distinct()
    words.write.bucketBy(spread, "unit").option("compression", "zstd").option("path", new_folder(spark, "units")).saveAsTable(name)
    try:
        held = spark.table(name)
        short = held.where(F.length("unit") <= BITS)
        ids = encode_units(short.select("unit").distinct(), path)
        long = held.where(F.length("unit") > BITS).mapInArrow(_encode_long(path), "chunk bigint, unit string, ids array<int>")
        both = short.join(ids.hint("shuffle_hash"), "unit").select("chunk", "unit", "ids").unionByName(long)
        # a chunk's words are spread over several tasks and files
        both.repartition("chunk", F.pmod(F.xxhash64("unit"), F.lit(8))).write.partitionBy("chunk").option("compression", "zstd").parquet(folder)
    finally:
        spark.sql(f"DROP TABLE {name}")
    return folder


class Dictionary:
    """Words and ids of one chunk; the last one read stays until the task ends."""

    _held: tuple[str, "Dictionary"] | None = None

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        where, base = open_fs(folder)
        from pyarrow import fs

        found = [f.path for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")]
        tables = [pq.read_table(f, filesystem=where, columns=["unit", "ids"], use_threads=False, pre_buffer=False) for f in found]
        t = pa.concat_tables(tables).combine_chunks() if tables else pa.table({"unit": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
        self.unit = t["unit"].combine_chunks() if t.num_rows else pa.array([], pa.string())
        ids = t["ids"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32()))
        begin = ids.offsets.to_numpy().astype(np.int64)
        self.begin, self.size, self.flat = begin[:-1], np.diff(begin), ids.values.to_numpy()

    @classmethod
    def of(cls, folder: str) -> "Dictionary":
        if cls._held is None or cls._held[0] != folder:
            cls._held = None
            cls._held = (folder, cls(folder))
        return cls._held[1]

    def places(self, words: list[pa.StringArray]) -> list[np.ndarray]:
        """Where each word is; the table of hashes is one of the distinct words given, not of all that are held."""
        coded = pa.concat_arrays(words).dictionary_encode()
        found = pc.index_in(self.unit, value_set=coded.dictionary)
        place = np.full(len(coded.dictionary), -1, np.int64)
        place[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        if (place < 0).any():
            raise ValueError(f"a word without ids: {coded.dictionary[int(place.argmin())]}")
        return np.split(place[coded.indices.to_numpy()], np.cumsum([len(w) for w in words[:-1]]))

    def encode(self, k: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end), from the places of their words."""
        if not len(k):
            return np.empty(0, np.int32), ends
        size = self.size[k]
        upto = np.cumsum(size)
        place = np.arange(upto[-1]) + np.repeat(self.begin[k] - (upto - size), size)
        return self.flat[place], np.r_[0, upto][ends]


def decode(ids: np.ndarray, ends: np.ndarray, table: pa.Array) -> pa.Array:
    """The texts of rows of ids as bytes, with the blank that the model puts before each."""
    held = pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends], pa.int64()), table.take(pa.array(ids)))
    return pc.binary_join(held, b"")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", per_chunk: int = 32_768, place: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids, round_trip)``, one row per row of ``docs``, with ``place`` if it is given.

    The distinct words of all texts are encoded once by the lattice. Rows are
    numbered in chunks of ``per_chunk`` by their place in the files, and each
    chunk has a file of its words' ids, so whole texts are never shuffled.
    ``place`` is a column that already numbers the rows without gaps.
    ``round_trip`` says whether decoding the ids gives the text back.

    Null and empty texts have no ids (and a round trip to the empty text). Rows
    with one id are encoded row by row. An empty table gives no rows.
    """
    at = place or new_name(docs, "place")
    rows = docs if place else numbered(docs, at)
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(at).alias("place"))
    src = src.select("id", "place", F.expr(f"cast(place div {per_chunk} as bigint)").alias("chunk"), "text")
    folder = write_dictionaries(src, path)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        p = pieces(path)
        table = pa.array(p.table, pa.binary())
        # words of 2 MB of text are looked up together; what else it takes to encode them is made for 512 KB at a time
        for chunk, rows in (x for b in batches for x in _slices(b, 21)):
            parts = [some for _, some in _slices(rows)]
            known, units = Dictionary.of(f"{folder}/chunk={chunk}"), [p.units(some.column("text").to_pylist()) for some in parts]
            for some, (_, ends), k in zip(parts, units, known.places([words for words, _ in units])):
                ids, ends = known.encode(k, ends)
                n = np.diff(np.r_[0, ends])
                text = pc.fill_null(some.column("text"), "").cast(pa.binary())
                text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(b" ", text, b""))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.record_batch([some.column("id"), some.column("place"), pa.array(n, pa.int64()), lists, pc.equal(decode(ids, ends, table), text)], names=["id", "place", "n_tokens", "ids", "round_trip"])
        Dictionary._held = None
        pa.default_memory_pool().release_unused()

    out = src.mapInArrow(run, f"id {kind}, place bigint, n_tokens bigint, ids array<int>, round_trip boolean")
    out = out.withColumnsRenamed({"id": id_col, "place": place or "_place"})
    return out if place else out.drop("_place")
