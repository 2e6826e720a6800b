"""Spelling variants: words one edit apart, found by dense tiles of prefix and suffix lengths, and grouped under their frequent forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import bounded, pieces_of, stored

#: Letters of a word: code points up to U+00FF, so a byte holds each.
_LETTERS = "[A-Za-zÀ-ÿ]"
_HELD = 400_000  # distinct words that a task holds before it gives their counts


def _tally(shortest: int, planted: bool):
    """(word, n) of some texts; a word may come several times."""
    longer = re.compile(f"{_LETTERS}{{{shortest},}}")

    def run(batches):
        total: Counter[str] = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in pieces_of(batches):
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                found = longer.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                if not planted or i is None:
                    total.update(found)
                    continue
                start = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(found).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % 31 == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < shortest:
                            continue
                    total[w] += n
            if len(total) > _HELD:
                yield flush()
        if total:
            yield flush()
        pa.default_memory_pool().release_unused()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, planted: bool = False) -> DataFrame:
    """``(word, n)``: maximal runs of letters of at least ``shortest`` code points, A-Z lower-cased, found ``least`` times or more.

    With ``planted`` a run loses one code point in the texts whose id and run ask for it.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = src.mapInArrow(_tally(shortest, planted), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _dealt(words: DataFrame, shortest: int) -> DataFrame:
    """``(key, size, kind, word, n)``: a row for each group in which a word is compared.

    Of two words one edit apart the shorter, of ``size`` code points, is cut in
    thirds. The edit lies in one of them, so the others are equal: the first two
    (kind 0), the last two (1) or the outer ones (2). A word takes part with its
    own length, and with one less, as the longer of two.
    """
    own = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(own, own - 1)).alias("size")).where(F.col("size") >= shortest)
    a, b = F.expr("size div 3"), F.expr("size * 2 div 3")
    text = F.col("word")
    tail = lambda k: F.right(text, F.col("size") - k)
    parts = F.array(F.left(text, b), tail(a), F.concat(F.left(text, a), F.lit("\n"), tail(b)))
    rows = roles.select("word", "n", "size", F.posexplode(parts).alias("kind", "part"))
    return rows.select(F.xxhash64("size", "kind", "part").alias("key"), F.col("size").cast("int").alias("size"), "kind", "word", "n")


def _matrix(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words as bytes, lengths, code points padded at the end, code points from the end on)."""
    text = [w.encode("latin-1") for w in words.to_pylist()]
    own = np.array([len(t) for t in text])
    text = np.array(text, f"S{max(1, own.max())}")
    head = text.view(np.uint8).reshape(len(text), -1)
    place = own[:, None] - 1 - np.arange(head.shape[1])[None, :]
    return text, own, head, np.where(place >= 0, np.take_along_axis(head, np.maximum(place, 0), 1), 0)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many code points two lists of words have in common from their start, row by row."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def _near(head: np.ndarray, tail: np.ndarray, size: np.ndarray, own: np.ndarray, kind: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one edit apart, each found in one of its groups only.

    ``head`` and ``tail`` are the padded code points from the start and from the
    end; common prefix plus common suffix reach the longer length less one.
    """
    short = np.minimum(own[i], own[j])
    prefix = np.minimum(_agree(head[i], head[j]), short)
    suffix = np.minimum(_agree(tail[i], tail[j]), short)
    long = np.maximum(own[i], own[j])
    a, b = short // 3, short * 2 // 3
    best = np.where(prefix >= b, 0, np.where(prefix >= a, 2, 1))
    return (size[i] == size[j]) & (kind[i] == kind[j]) & (short == size[i]) & (long <= short + 1) & (prefix + suffix >= long - 1) & (kind[i] == best)


def _whole_tiles(batches):
    """Tables of consecutive rows that hold the rows of a tile together."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("tile").to_numpy()
        starts = np.flatnonzero(key[1:] != key[:-1]) + 1
        cut = int(starts[-1]) if len(starts) else 0
        if held and (cut or key[0] != last):
            yield pa.Table.from_batches(held + [b.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _alike(t: pa.Table, cells: int):
    """Parts of a table with words of like lengths, of about ``cells`` padded code points, cut between tiles."""
    width = np.frexp(t["size"].to_numpy() + 1)[1]
    for w in np.unique(width):
        some = t.filter(pa.array(width == w)) if (width != w).any() else t
        tile = some["tile"].to_numpy()
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        at = starts[np.flatnonzero(np.r_[True, np.diff((starts << int(w)) // cells) > 0])]
        for i, j in zip(at, [*at[1:], len(tile)]):
            if j - i > 1:
                yield some.slice(i, j - i).combine_chunks()


def _tiles(batches):
    """``(word, near, best_n, best)`` of the words of each tile: how many near words it holds, and the one of largest n.

    Rows of one tile stand together. Every row is compared with the one 1, 2, 3,
    ... rows further on, all tiles at once, until no tile is so long. Rows of
    two blocks are compared across the blocks only.
    """
    for t in (part for whole in _whole_tiles(batches) for part in _alike(whole, 1 << 22)):
        tile, size, kind, block, n, split = (t[c].to_numpy(zero_copy_only=False) for c in ("tile", "size", "kind", "block", "n", "split"))
        words = t["word"].combine_chunks()
        text, own, head, tail = _matrix(words)
        one, two, d = [], [], 1
        i = np.flatnonzero(tile[1:] == tile[:-1])
        while len(i):
            ok = ~split[i] | (block[i] != block[i + d])
            some = i[ok]
            hit = _near(head, tail, size, own, kind, some, some + d)
            one.append(some[hit])
            two.append(some[hit] + d)
            d += 1
            i = i[i + d < len(tile)]
            i = i[tile[i] == tile[i + d]]
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, two))
        if not len(i):
            continue
        me, other = np.r_[i, j], np.r_[j, i]
        order = np.lexsort((text[other], -n[other], me))  # bytes are in code-point order
        me, other = me[order], other[order]
        first = np.flatnonzero(np.r_[True, me[1:] != me[:-1]])
        yield pa.record_batch([
            words.take(pa.array(me[first])), pa.array(np.diff(np.r_[first, len(me)])), pa.array(n[other[first]]), words.take(pa.array(other[first])),
        ], names=["word", "near", "best_n", "best"])


def near_words(words: DataFrame, shortest: int = 7, block: int = 256) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``words`` (``word``, ``n``) that have near ones.

    The words are all different, of ``shortest`` or more code points up to U+00FF.
    Near are two words that differ by one inserted, deleted or replaced code
    point. Words are compared in groups (see ``_dealt``). A group of more than
    ``block`` words is cut into blocks, and every two of its blocks are a tile of
    their own, so no task holds a large group; a pair counts in one tile only.
    """
    rows = stored(_dealt(words, shortest), "roles")
    large = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = stored(large.select("key", F.ceil(F.col("m") / block).cast("int").alias("parts")), "large")
    rows = rows.join(bounded(large), "key", "left")
    rows = rows.withColumn("block", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("word", F.lit(3)), F.col("parts"))).cast("int"))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", F.explode(other))
    tile = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    rows = rows.select(tile.alias("tile"), "size", "kind", "block", (F.col("block") != F.col("other")).alias("split"), "word", "n")
    found = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, "word string, near bigint, best_n bigint, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the forms of ``forms`` (``word``, ``form``) lead to, by doubling.

    Each form is at least so many times as frequent as its word that a chain is
    never long; every join halves what is left of it.
    """
    up = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        top = up.select(F.col("word").alias("mid"), F.col("root").alias("top"))
        new = stored(up.join(top, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        up = new.select("word", "root")
        if new.where("moved").isEmpty():
            return up


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, ratio: int = 10, block: int = 256, planted: bool = False) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word that is found ``least`` times or more.

    Words are maximal runs of letters ``A-Za-z`` and U+00C0 to U+00FF of at least
    ``shortest`` code points (lower-cased in A-Z only) of whole texts. A word's form
    is its most frequent near word (ties: the first in code-point order), if that
    is ``ratio`` times as frequent; its root is where forms lead to, the word itself
    if it has none. ``planted`` deletes a code point of some runs, by id and run.

    Null and empty texts have no words; rows of a null id delete nothing; rows
    repeated whole count again. A very long word is compared like any other.
    An empty table gives no rows.
    """
    if ratio < 2 or shortest < 3:
        raise ValueError("forms must be more frequent, and words have thirds")
    words = stored(word_counts(docs, id_col, text_col, shortest, least, planted), "words")
    near = stored(near_words(words, shortest, block), "near")
    of = words.join(near, "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    of = stored(of.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "variants")
    roots = _roots(of.where("form is not null"))
    return of.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
