"""Near-duplicate documents by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded, mix, new_name, numbered, pieces_of, shingles, stored
from .components import components

_LEVELS = 4


def _signatures(trees: int, size: int):
    """Per document: set size, a 128-bit mark of the whole set, and trees x levels minwise tokens."""
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, trees * _LEVELS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    odd = seeds | np.uint64(1)

    def run(batches):
        for b in pieces_of(batches):
            ids, n, m1, m2, sig = b.column("id"), [], [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text, size)
                n.append(len(h))
                with np.errstate(over="ignore"):
                    m1.append(int(mix(h).sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                    m2.append(int(np.bitwise_xor.reduce(mix(h + np.uint64(77))).astype(np.int64)) if len(h) else 0)
                    low = np.full(len(odd), np.iinfo(np.uint64).max)
                    for i in range(0, len(h), 1024):
                        part = h[i : i + 1024]
                        np.minimum(low, ((part[None, :] ^ seeds[:, None]) * odd[:, None]).min(axis=1), out=low)
                sig.append((low >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(m1, pa.int64()), pa.array(m2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "m1", "m2", "sig"])

    return run


def _nodes(batches):
    """The consecutive rows of each node: (ids, set sizes, components, signatures)."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("node").to_numpy()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for i, j in zip(at, [*at[1:], len(key)]):
            if held and key[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _columns(t: pa.Table) -> tuple:
    ids, n, comp = (t.column(c).to_numpy() for c in ("id", "n", "comp"))
    return ids, n, comp, np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(len(ids), -1)


def _equal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many tokens of every two signatures are equal."""
    same = np.zeros((len(one), len(two)), np.uint16)
    for j in range(one.shape[1]):
        same += one[:, j][:, None] == two[:, j][None, :]
    return same


def _like(n_one: np.ndarray, n_two: np.ndarray, percent: int) -> np.ndarray:
    """Sets whose sizes differ by more than this can't be links."""
    a, b = n_one[:, None], n_two[None, :]
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _star(likely: float, percent: int):
    """``(a, b)``: every document of a node with the first one before it that is likely a link.

    The rows of a node come one after the other, sorted by id.
    """

    def run(batches):
        for t in _nodes(batches):
            if t.num_rows < 2:
                continue
            ids, n, _, sig = _columns(t)
            ok = (_equal(sig, sig) >= likely * sig.shape[1]) & _like(n, n, percent) & np.tri(len(ids), k=-1, dtype=bool)
            i = np.flatnonzero(ok.any(axis=1))
            yield pa.record_batch([pa.array(ids[ok[i].argmax(axis=1)]), pa.array(ids[i])], names=["a", "b"])

    return run


def _hopeful(least: float, percent: int):
    """``(node, id, comp)`` of the documents of a node that may be linked with one of another component there."""

    def run(batches):
        for t in _nodes(batches):
            ids, n, comp, sig = _columns(t)
            ok = (_equal(sig, sig) >= least * sig.shape[1]) & _like(n, n, percent) & (comp[:, None] != comp[None, :])
            if ok.any():
                yield t.filter(pa.array(ok.any(axis=1))).select(["node", "id", "comp"]).combine_chunks().to_batches()[0]

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of some sets."""
    m = len(sets)
    owner, (_, at) = np.repeat(np.arange(m), [len(x) for x in sets]), np.unique(np.concatenate(sets), return_inverse=True)
    order = np.lexsort((owner, at))
    owner, at = owner[order], at[order]
    count = np.bincount(at)
    out = np.zeros(m * m, np.int64)
    rare = count[at] <= 16
    o, h = owner[rare], at[rare]
    for k in range(1, 16):  # an element of few sets: the pairs of those sets
        i = np.flatnonzero(h[:-k] == h[k:]) if len(h) > k else []
        if not len(i):
            break
        out += np.bincount(o[i] * m + o[i + k], minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    o, h = owner[~rare], np.unique(at[~rare], return_inverse=True)[1]
    width = max(1, (4 << 20) // m)
    for start in range(0, int(h.max()) + 1 if len(h) else 0, width):
        i = slice(*np.searchsorted(h, [start, start + width]))
        x = np.zeros((m, width), np.float32)
        x[o[i], h[i] - start] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _forest(t: pa.Table, percent: int) -> tuple[list, list]:
    """Links between the components of some rows with full sets, at most one less than there are components."""
    ids, comp, sets = t.column("id").to_numpy(), t.column("comp").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
    n, both = np.array([len(x) for x in sets]), _shared(sets)
    ok = (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
    i, j = np.nonzero(np.triu(ok, 1))
    top = {c: c for c in comp.tolist()}

    def find(c):
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = find(comp[x]), find(comp[y])
        if p != q:
            top[max(p, q)] = min(p, q)
            a.append(ids[x]), b.append(ids[y])
    return a, b


def _links(percent: int):
    """Links between the components of each node, by full sets."""

    def run(batches):
        for t in _nodes(batches):
            a, b = _forest(t, percent)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _large_links(rows: DataFrame, packed: DataFrame, block: int, percent: int) -> DataFrame:
    """Links of large nodes, every two documents of different components compared by full sets.

    A component as large as a block has blocks of its own, which are not
    compared with each other; the others share blocks.
    """
    sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("n"))
    sizes = stored(sizes.withColumn("alone", F.col("n") >= block), "sizes")
    rest = sizes.where("not alone").groupBy("node").agg(F.sum("n").alias("rest"))
    of = sizes.join(rest, "node", "left").select(
        "node", "comp", "alone", F.when(F.col("alone"), F.col("comp")).alias("own"),
        F.ceil(F.when(F.col("alone"), F.col("n")).otherwise(F.col("rest")) / block).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.col("parts"))
    placed = rows.join(of, ["node", "comp"]).withColumn("blk", F.xxhash64("own", part("id")))
    placed = stored(placed.select("node", "id", "comp", "own", "blk"), "placed")
    blocks = stored(placed.select("node", "own", "blk").distinct(), "blocks")
    x = blocks.select("node", F.col("own").alias("o1"), F.col("blk").alias("b1"))
    y = blocks.select("node", F.col("own").alias("o2"), F.col("blk").alias("b2"))
    # of a node's blocks every two, but not two of one component
    pairs = x.join(y, "node").where("b1 <= b2 and (o1 is null or o2 is null or o1 <> o2)").withColumn("key", F.xxhash64("node", "b1", "b2"))
    sides = pairs.select("node", "key", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("blk"))
    work = placed.join(sides, ["node", "blk"]).join(packed, "id").select(F.col("key").alias("node"), "id", "comp", "set")
    return work.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_links(percent), "a bigint, b bigint")


def _pack(size: int):
    """Each text's set as the bytes of its sorted hashes."""

    def run(batches):
        for b in pieces_of(batches):
            yield pa.record_batch([b.column("id"), pa.array([shingles(t.as_py(), size).tobytes() for t in b.column("text")], pa.binary())], names=["id", "set"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in pieces_of(batches):
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(ok)], names=["a", "b", "ok"])

    return run


def _branches(reps: DataFrame, trees: int, node_size: int) -> DataFrame:
    """``(node, id, n_node)``: the nodes of more than one document at which the trees stop.

    Every tree sends a document down the branch of its least token under that
    tree's hash; a node of more than ``node_size`` documents branches again by
    the next hash, four levels deep.
    """
    token = lambda i: F.substring("sig", i * 4 + 1, 4)
    path = lambda t, d: F.xxhash64(F.lit(t), *[token(t * _LEVELS + j) for j in range(d + 1)])
    first = reps.select("id", F.posexplode(F.array(*[path(t, 0) for t in range(trees)])).alias("t", "node"))
    shared = first.groupBy("node").agg(F.count("*").alias("n_node")).where("n_node > 1")
    first = stored(first.join(stored(shared, "shared"), "node").select("node", "id", "t", "n_node"), "branches")
    small, large = first.where(F.col("n_node") <= node_size), first.where(F.col("n_node") > node_size).select("id", "t")
    if large.isEmpty():
        return small.drop("t")
    levels = range(1, _LEVELS)
    paths = F.array(*[F.array(*[path(t, d) for d in levels]) for t in range(trees)])
    deep = large.join(reps.select("id", paths.alias("p")), "id").select("id", "t", F.posexplode(F.get("p", F.col("t"))).alias("d", "node"))
    deep = stored(deep, "deep")
    shared = deep.groupBy("node").agg(F.count("*").alias("n_node")).where("n_node > 1")
    deep = deep.join(stored(shared, "counts"), "node").groupBy("id", "t").agg(
        F.min(F.when(F.col("n_node") <= node_size, F.struct("d", "node", "n_node"))).alias("fits"),
        F.max(F.struct("d", "node", "n_node")).alias("last"))
    # the first node that is small enough, else the last one if the branch goes on to the end
    x = F.coalesce("fits", F.when(F.col("last.d") == len(levels) - 1, F.col("last"))).alias("x")
    deep = deep.select("id", x).where("x is not null").select("x.node", "id", "x.n_node")
    return small.select("node", "id", "n_node").unionByName(deep)


def trees_for(recall: float, percent: int = 75) -> int:
    """Trees with which two documents just alike enough meet in a full-depth node with a chance of ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** _LEVELS))


def near_rows(
    src: DataFrame,
    size: int = 5,
    percent: int = 75,
    recall: float = 0.997,
    node_size: int = 48,
    block: int = 512,
    least: float = 0.5,
    likely: float = 0.8,
) -> DataFrame:
    """``(id, n, component)`` of texts ``(id, text)`` whose ids are all different: set size, least id reachable.

    Independent trees (see ``_branches``), as many as ``recall`` asks for, put
    documents in nodes; small nodes are compared exhaustively, first on
    signatures, then on full shingle sets. This goes in two rounds, so that a
    group of copies costs about one pair per document and not all its pairs:
    first every document with one that is likely a link (a large node in blocks
    that all hold the node's first document), then all documents of a node whose
    components are still apart; large nodes block by block. The second round
    ships the sets to the nodes and gives back only links that join components.
    A pair in one small node is lost only if its signatures agree in less than
    ``least`` of their tokens. Documents with equal sets are grouped first.
    """
    trees = trees_for(recall, percent)
    sets = stored(src.mapInArrow(_signatures(trees, size), "id bigint, n bigint, m1 bigint, m2 bigint, sig binary"), "signatures")
    reps = stored(sets.where("n > 0").groupBy("n", "m1", "m2").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "sets")
    member = stored(_branches(reps, trees, node_size), "nodes")
    sig = reps.select("id", "n", "sig")

    def packed(ids: DataFrame) -> DataFrame:
        """``(id, set)``; each text is cut into shingles once."""
        need = bounded(stored(ids.distinct(), "needed"))
        return stored(src.join(need, "id", "left_semi").mapInArrow(_pack(size), "id bigint, set binary"), "packed")

    large = member.where(F.col("n_node") > node_size)
    rows = member.where(F.col("n_node") <= node_size).select("node", "id")
    has_large = not large.isEmpty()
    if has_large:
        first = large.groupBy("node").agg(F.min("id").alias("id"), F.max("n_node").alias("m"))
        led = first.select("node", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / block) - 1)).alias("blk"))
        own = large.select("node", "id", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n_node") / block)).alias("blk"))
        rows = rows.unionByName(own.unionByName(led).distinct().select(F.xxhash64("node", "blk").alias("node"), "id"))
    rows = rows.join(sig, "id").select("node", "id", "n", F.col("id").alias("comp"), "sig").repartition("node").sortWithinPartitions("node", "id")
    # one link a document: the first of those that it may have
    pairs = stored(rows.mapInArrow(_star(likely, percent), "a bigint, b bigint").groupBy("b").agg(F.min("a").alias("a")), "pairs")
    sets_of = packed(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(sets_of.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets_of.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    links = stored(both.mapInArrow(_verify(percent), "a bigint, b bigint, ok boolean").where("ok").select("a", "b"), "links")
    up = links.select(F.col("b").alias("of"), F.col("a").alias("component"))
    for _ in range(2):  # links of links: rows of one label are of one component, which is all that the next round needs
        top = up.select(F.col("of").alias("mid"), F.col("component").alias("top"))
        up = stored(up.join(top, F.col("component") == F.col("mid"), "left").select("of", F.coalesce("top", "component").alias("component")), "labels")

    rows = member.join(up, member.id == up.of, "left").select("node", "id", "n_node", F.coalesce("component", "id").alias("comp"))
    # a node whose documents are all in one component has nothing left to compare
    open_ = rows.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node")
    rows = stored(rows.join(open_, "node", "left_semi"), "open")
    small = rows.where(F.col("n_node") <= node_size).join(sig, "id").select("node", "id", "n", "comp", "sig")
    small = small.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_hopeful(least, percent), "node bigint, id bigint, comp bigint")
    small, large = stored(small, "hopeful"), rows.where(F.col("n_node") > node_size).select("node", "id", "comp")
    sets_of = packed(small.select("id").unionByName(large.select("id")))
    more = small.join(sets_of, "id").repartition("node").sortWithinPartitions("node", "id").mapInArrow(_links(percent), "a bigint, b bigint")
    if has_large:
        more = more.unionByName(_large_links(large, sets_of, block, percent))
    comp = components(links.unionByName(stored(more, "more")), "a", "b").select(F.col("node").alias("of"), "component")
    of = reps.join(comp, reps.id == comp.of, "left").select("n", "m1", "m2", F.coalesce("component", "id").alias("rep"))
    out = sets.drop("sig").join(stored(of, "groups"), ["n", "m1", "m2"], "left")
    return out.select("id", "n", F.coalesce("rep", "id").alias("component"))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``docs``; ``how`` is that of ``near_rows``.

    Rows are compared by themselves, whatever their ids: rows of one id may be in
    different components. The component of a row is the least id of all rows that it
    reaches, null where none of them has an id; such rows are kept, all others if
    the component is their id. Null or wordless texts have an empty set and link
    with nothing; fewer words than ``size`` are one shingle. An empty table gives no rows.
    """
    row = new_name(docs, "row")
    rows = numbered(docs, row)
    of = near_rows(rows.select(F.col(row).alias("id"), F.col(text_col).alias("text")), **how)
    ids = rows.select(F.col(row).alias("_at"), F.col(id_col).alias("_id"))
    of = stored(of.join(ids, F.col("id") == F.col("_at")).select("_id", "n", "component"), "components")
    first = stored(of.groupBy("component").agg(F.min("_id").alias("_first")), "first")  # so that Spark may split a large component in the join
    out = of.join(first, "component").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_first").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of every component of ``near_documents``, with its own columns.

    Rows are compared by themselves, also where ids repeat or are null: of a
    component the row with the least id is kept, null ids last. A row without
    words links with nothing and is kept; such rows repeated whole are kept once.
    """
    row, at, first = (new_name(docs, x) for x in ("row", "at", "first"))
    rows = numbered(docs, row)
    of = near_rows(rows.select(F.col(row).alias("id"), F.col(text_col).alias("text")), **how)
    of = of.select(F.col("id").alias(at), "n", "component")
    of = stored(of.join(rows.select(F.col(row).alias("_row"), F.col(id_col).alias("_id")), F.col(at) == F.col("_row")).drop("_row"), "components")
    least = F.min(F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col(at).alias("at"))).alias("best")
    best = of.where("n > 0").groupBy("component").agg(least).select("component", F.col("best.at").alias("best"))
    best = stored(best, "best")  # so that Spark may split a large component in the join
    gone = of.where("n > 0").join(best, "component").where(F.col(at) != F.col("best")).select(at)
    bare = rows.join(bounded(stored(of.where("n = 0").select(at), "bare")), F.col(row) == F.col(at), "left_semi")
    once = stored(bare.groupBy(*[F.col(f"`{c}`") for c in docs.columns]).agg(F.min(row).alias(first)).select(first), "first")
    again = bare.select(F.col(row).alias(at)).join(once, F.col(at) == F.col(first), "left_anti")
    gone = bounded(stored(gone.unionByName(again), "gone"))
    return rows.join(gone, F.col(row) == F.col(at), "left_anti").drop(row)
