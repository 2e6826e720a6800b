"""Near-duplicate vectors by NN-descent over a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._common import bounded, cut, numbered, stored
from .components import components

_EDGES = "a bigint, b bigint, sim double"
_BITS = 24  # the most hyperplanes of a table


def _unit(col: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision."""
    n = len(col)
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(batches: Iterator[pa.RecordBatch], vec: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has vectors of one length."""
    for b in batches:
        if b.num_rows:
            length = pc.list_value_length(b.column(vec)).to_numpy(zero_copy_only=False)
            for n in np.unique(length):
                yield b if (length == n).all() else b.filter(pa.array(length == n))


def _runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Consecutive rows of one key, in pieces of at most ``most`` rows; True with a key's first piece."""
    held: list[pa.RecordBatch] = []
    rows, last, first = 0, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for i, j in zip(at, np.r_[at[1:], len(k)]):
            if held and k[i] != last:
                yield pa.Table.from_batches(held), first
                held, rows, first = [], 0, True
            last = k[i]
            while i < j:
                take = min(j - i, most - rows)
                held.append(batch.slice(i, take))
                rows, i = rows + take, i + take
                if rows >= most:
                    yield pa.Table.from_batches(held), first
                    held, rows, first = [], 0, False
    if held:
        yield pa.Table.from_batches(held), first


def _edges(a, b, s) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "sim"])


def _top(ids: np.ndarray, other: np.ndarray, sims: np.ndarray, k: int, low: np.ndarray | float) -> tuple:
    """For each row, its k largest similarities above ``low``."""
    sims = np.where(ids[:, None] == other[None, :], -2.0, sims)
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    val = np.take_along_axis(sims, top, 1)
    keep = val > (low[:, None] if isinstance(low, np.ndarray) else low)
    return np.repeat(ids, k)[keep.ravel()], other[top][keep], val[keep]


def _start(nodes: DataFrame, tables: int, k: int, floor: float, seed: int, most: int) -> DataFrame:
    """First lists: exhaustive comparison inside cells of random hyperplanes, several times over."""

    def cells(batches):
        for b in _by_length(batches, "vec"):
            x = _unit(b.column("vec"))
            part, bits = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "bits"))
            most_bits, mask = int(bits.max()), (np.int64(1) << bits) - 1
            for t in range(tables):
                planes = np.random.default_rng((seed, t, x.shape[1])).standard_normal((_BITS + 1, x.shape[1]))
                code = ((x @ planes[1 : most_bits + 1].T > 0) @ (1 << np.arange(most_bits, dtype=np.int64))).astype(np.int64) & mask
                cell = pa.array(((part * np.int64(tables) + t) << np.int64(_BITS)) + code)
                out = pa.record_batch([cell, pa.array(x @ planes[0]), b.column("rid"), b.column("vec")], names=["cell", "along", "rid", "vec"])
                yield out.filter(pa.array(bits > 0)) if t else out  # a part of one cell is compared whole once

    def compare(batches):
        ids0, x0 = None, None
        for t, first in _runs(batches, "cell", most):
            ids, x = t["rid"].to_numpy(), _unit(t["vec"].combine_chunks())
            if first:
                ids0, x0 = ids[:0], x[:0]
            ids0, x0 = np.r_[ids0, ids], np.r_[x0, x]
            if len(ids0) > 1:
                yield _edges(*_top(ids0, ids0, x0 @ x0.T, k, floor))
            ids0, x0 = ids0[-most // 4 :], x0[-most // 4 :]  # a cell in several pieces overlaps

    vec = nodes.schema["vec"].dataType.simpleString()
    by_cell = nodes.select("part", "bits", "rid", "vec").mapInArrow(cells, f"cell bigint, along double, rid bigint, vec {vec}")
    return by_cell.repartition("cell").sortWithinPartitions("cell", "along").select("cell", "rid", "vec").mapInArrow(compare, _EDGES)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of every vector; each source of edges gives it a bounded number."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _descend(nodes: DataFrame, lists: DataFrame, k: int, floor: float) -> DataFrame:
    """One round: the members of every vector's list (both directions) are compared with each other."""

    def join(batches):
        for t, _ in _runs(batches, "u", 4 * k):
            ids, at = np.unique(t["m"].to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            x, low = _unit(t["vec"].combine_chunks())[at], t["low"].to_numpy()[at]
            yield _edges(*_top(ids, ids, x @ x.T, k, low))

    low = lists.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(floor)).alias("low"))
    known = nodes.join(low, nodes.rid == low.a, "left").select("rid", "vec", F.coalesce("low", F.lit(floor)).alias("low"))
    w = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
    back = lists.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(F.col("b").alias("u"), F.col("a").alias("m"))
    pairs = lists.select(F.col("a").alias("u"), F.col("b").alias("m")).unionByName(back)
    rows = pairs.join(known, pairs.m == known.rid).select("u", "m", "vec", "low")
    return rows.repartition("u").sortWithinPartitions("u").mapInArrow(join, _EDGES)


def _forest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a block of links between two lists of vectors."""
    out, row_new, col_new = [], np.ones(len(rows), bool), np.ones(len(cols), bool)
    for s in range(len(rows)):
        if not row_new[s]:
            continue
        row_new[s], todo = False, [s]
        while todo:
            i = todo.pop()
            js = np.flatnonzero(link[i] & col_new)
            col_new[js] = False
            for j in js:
                out.append((rows[i], cols[j]))
                more = np.flatnonzero(link[:, j] & row_new)
                row_new[more] = False
                out += [(rows[m], cols[j]) for m in more]
                todo += more.tolist()
    return out


def _saturated(nodes: DataFrame, lists: DataFrame, full: DataFrame, threshold: float, block: int = 512, pivots_at_once: int = 2048) -> DataFrame:
    """Whole lists of the vectors whose list holds links only.

    Every group of such vectors gets a pivot; with the pivot's widest member at
    angle r (found first), a link of any member lies within r + acos(threshold) of the pivot,
    so only those vectors are compared, block by block, with the group.
    Rows: kind n (a: vector, b: how many rows it links with), e (an edge of a
    spanning forest), u (a link a-b whose a is not saturated).
    """
    spark = nodes.sparkSession
    links = lists.where(F.col("sim") >= threshold)
    inner = links.join(full.select(F.col("rid").alias("a")), "a", "left_semi").join(full.select(F.col("rid").alias("b")), "b", "left_semi")
    comp = components(inner, "a", "b")
    of = cut(full.join(comp, full.rid == comp.node, "left").select("rid", F.coalesce("component", "rid").alias("pivot")))
    vec = nodes.schema["vec"].dataType.simpleString()
    member = cut(nodes.join(of, "rid", "left").select("rid", "part", "vec", "mult", "pivot"))
    pivots = of.select("pivot").distinct().join(nodes, F.col("pivot") == F.col("rid")).select("pivot", "part", F.col("vec").alias("centre"))

    def own_angle(batches):
        for b in _by_length(batches, "vec"):
            cos = (_unit(b.column("vec")) * _unit(b.column("centre"))).sum(axis=1)
            yield pa.record_batch([b.column("pivot"), pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["pivot", "angle"])

    own = member.where("pivot is not null").select("pivot", "vec").join(pivots, "pivot")
    own = own.select("pivot", "vec", "centre").mapInArrow(own_angle, "pivot bigint, angle double")
    radius = own.groupBy("pivot").agg(F.max("angle").alias("r"), F.count("*").alias("nq"))
    pivots = cut(pivots.join(radius, "pivot"))
    n_blocks = max(1, math.ceil(pivots.count() / pivots_at_once))
    reach = math.acos(threshold) + 1e-6
    near = None
    for i in range(n_blocks):  # each block of pivots is bounded
        some = pivots.where(F.pmod(F.xxhash64("pivot"), F.lit(n_blocks)) == i).toPandas()
        if some.empty:
            continue
        by_part = {p: (g["pivot"].to_numpy(), _unit(pa.array([np.asarray(v) for v in g["centre"]])), g["r"].to_numpy() + reach, g["nq"].to_numpy()) for p, g in some.groupby("part")}
        shared = spark.sparkContext.broadcast(by_part)

        def angles(batches, shared=shared):
            for b in _by_length(batches, "vec"):
                part, pivot = b.column("part").to_numpy(), b.column("pivot").to_numpy(zero_copy_only=False)
                for p in np.unique(part):
                    if p not in shared.value:
                        continue
                    at = np.flatnonzero(part == p)
                    ids, y, far, nq = shared.value[p]
                    angle = np.arccos(np.clip(_unit(b.column("vec").take(pa.array(at))) @ y.T, -1, 1))
                    i, j = np.nonzero((angle <= far[None, :]) | (pivot[at][:, None] == ids[None, :]))
                    yield pa.record_batch([pa.array(ids[j]), b.column("rid").take(pa.array(at[i])), pa.array(nq[j])], names=["pivot", "rid", "nq"])

        got = member.select("rid", "part", "vec", "pivot").mapInArrow(angles, "pivot bigint, rid bigint, nq bigint")
        near = got if near is None else near.unionByName(got)
    cand = cut(near)
    size = cand.groupBy("pivot").agg(F.count("*").alias("nc"), F.first("nq").alias("nq"))
    size = size.select("pivot", F.ceil(F.col("nq") / block).cast("int").alias("qs"), F.ceil(F.col("nc") / block).cast("int").alias("cs"))
    rows = cand.select("pivot", "rid").join(size, "pivot").join(member.withColumnRenamed("pivot", "own"), "rid")
    side = lambda q: F.pmod(F.xxhash64("rid", F.lit(7)), F.col(q)).cast("int")
    queries = rows.where("own = pivot").select("pivot", side("qs").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("cb"), F.lit(True).alias("q"), "rid", "vec", "mult", "own")
    others = rows.select("pivot", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), side("cs").alias("cb"), F.lit(False).alias("q"), "rid", "vec", "mult", "own")
    blocks = queries.unionByName(others).withColumn("key", F.xxhash64("pivot", "qb", "cb"))

    def compare(batches):
        for t, _ in _runs(batches, "key", 1 << 30):
            q = t["q"].to_numpy()
            if q.all() or not q.any():
                continue
            ids, mult, x = t["rid"].to_numpy(), t["mult"].to_numpy(), _unit(t["vec"].combine_chunks())
            sat = np.asarray(t["own"].is_valid())
            a, b = ids[q], ids[~q]
            link = (x[q] @ x[~q].T >= threshold) & (a[:, None] != b[None, :])
            kinds, one, two = ["n"] * len(a), list(a), list(link @ mult[~q])
            f = _forest(link, a, b)
            i, j = np.nonzero(link[:, ~sat[~q]])
            loose = b[~sat[~q]]
            kinds += ["e"] * len(f) + ["u"] * len(i)
            one += [e[0] for e in f] + list(loose[j])
            two += [e[1] for e in f] + list(a[i])
            yield pa.record_batch([pa.array(kinds), pa.array(np.array(one, np.int64)), pa.array(np.array(two, np.int64))], names=["kind", "a", "b"])

    return blocks.repartition("key").sortWithinPartitions("key").select("key", "q", "rid", "vec", "mult", "own").mapInArrow(compare, "kind string, a bigint, b bigint")


def _exact(nodes: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """All links within the parts of ``nodes``, block by block.

    Rows: kind n (a: vector, b: how many rows it links with), e (an edge of a
    block's spanning forest), so no list of a dense group's pairs is built.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = nodes.select("part", "rid", "vec", "mult", blocks.alias("nb"), F.pmod(F.xxhash64("rid", F.lit(13)), blocks).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("key", F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other")))

    def compare(batches):
        for t, _ in _runs(batches, "key", 1 << 30):
            own, ids, mult, x = t["own"].to_numpy(), t["rid"].to_numpy(), t["mult"].to_numpy(), _unit(t["vec"].combine_chunks())
            one = own == own.min()
            two = ~one if own.min() != own.max() else one
            if own.min() == own.max() and (t["other"].to_numpy() != own).any():
                continue  # the other block is empty
            link = (x[one] @ x[two].T >= threshold) & (ids[one][:, None] != ids[two][None, :])
            f = _forest(link, ids[one], ids[two])
            n = [(ids[one], link @ mult[two])] + ([(ids[two], mult[one] @ link)] if own.min() != own.max() else [])
            kinds = ["e"] * len(f) + ["n"] * sum(len(i) for i, _ in n)
            a = np.concatenate([np.array([e[0] for e in f], np.int64), *[i for i, _ in n]])
            b = np.concatenate([np.array([e[1] for e in f], np.int64), *[c for _, c in n]])
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").select("key", "own", "other", "rid", "vec", "mult").mapInArrow(compare, "kind string, a bigint, b bigint")


def audit(nodes: DataFrame, links: DataFrame, full: DataFrame, threshold: float, sample: int) -> dict[tuple[int, bool], float]:
    """Mean share of its true links that ``links`` (rid, n) counts for a vector, by (bits, saturated).

    Parts with one number of bits have cells of one kind. Of each number of
    bits, up to ``sample`` vectors without links found, with one or two, with
    more, and of the saturated ones (``full``) are compared with their whole
    part; strata are weighted by their sizes. Parts of no bits are compared
    whole anyway and not sampled.
    """
    of = nodes.where("bits > 0").join(links, "rid", "left").join(full.select("rid", F.lit(True).alias("sat")), "rid", "left")
    n = F.coalesce("n", F.lit(0))
    kind = F.when(F.col("sat"), 3).when(n == 0, 0).when(n <= 2, 1).otherwise(2)
    of = of.select("rid", "bits", kind.alias("kind"), n.alias("n"))
    sizes = {(r.bits, r.kind): r["count"] for r in of.groupBy("bits", "kind").count().collect()}  # at most 4 a number of bits
    if not sizes:
        return {}
    picked = None
    for (bits, k), size in sizes.items():
        share = min(1.0, 1.5 * sample / size + 50 / size)
        some = of.where((F.col("bits") == bits) & (F.col("kind") == k) & (F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    q = picked.join(nodes.select("rid", "part", "vec"), "rid").toPandas()
    by_part = {p: (g["rid"].to_numpy(), _unit(pa.array([np.asarray(v) for v in g["vec"]]))) for p, g in q.groupby("part")}
    shared = nodes.sparkSession.sparkContext.broadcast(by_part)

    def count(batches):
        for b in _by_length(batches, "vec"):
            part, mult, rid = (b.column(c).to_numpy() for c in ("part", "mult", "rid"))
            for p in np.unique(part):
                if p in shared.value:
                    at = np.flatnonzero(part == p)
                    ids, y = shared.value[p]
                    link = (_unit(b.column("vec").take(pa.array(at))) @ y.T >= threshold) & (rid[at][:, None] != ids[None, :])
                    yield pa.record_batch([pa.array(ids), pa.array((mult[at][:, None] * link).sum(0))], names=["rid", "true"])

    true = nodes.where("bits > 0").select("rid", "part", "vec", "mult").mapInArrow(count, "rid bigint, true bigint").groupBy("rid").agg(F.sum("true").alias("true"))
    q = q.drop(columns=["vec"]).merge(true.toPandas(), on="rid")
    out = {}
    for bits in {b for b, _ in sizes}:
        for sat in (False, True):
            got, all_ = 0.0, 0.0
            for k in [3] if sat else [0, 1, 2]:
                s = q[(q.bits == bits) & (q.kind == k)]
                linked = s[s.true > 0]
                if len(linked):
                    weight = sizes[bits, k] / len(s)
                    all_ += weight * len(linked)
                    got += weight * float((np.minimum(linked.n, linked.true) / linked.true).sum())
            out[bits, sat] = got / all_ if all_ else 1.0
    return out


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    group_col: str = "label",
    threshold: float = 0.93,
    k: int = 10,
    tables: int = 12,
    cell: int = 96,
    rounds: int = 2,
    floor: float = 0.5,
    recall: float = 0.995,
    audit_sample: int = 200,
    tries: int = 3,
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``df``.

    Vectors are compared within one group only. A neighbour graph starts from
    cells of random hyperplanes and is refined ``rounds`` times by comparing the
    neighbours of each vector with each other; a list that is full of links is
    enlarged to all of its links (see ``_saturated``). Cells are as fine as the
    vector's own group asks for. Recall is audited against brute force (see
    ``audit``), and where it is below ``recall`` more cells are added. Groups
    that still fail after ``tries`` are compared block by block; those too large
    to be cheaper that way get up to four times as many tries before it.
    Lists leave out neighbours below ``floor``, which lead to no link.

    Null vectors, zero vectors, null or non-finite components and a null group
    link with nothing: n_links 0, their own component. Vectors of one group link
    only with those of their own length.
    Equal vectors are compared once and count as links of each other. Rows with
    one id are vectors of their own: each counts its own links and may be in
    another component. The component of a row is the least id of all rows
    that its vector reaches, null where none of them has an id; such rows are
    kept, all others if the component is their id. An empty table gives no rows.
    """
    d = F.col("_v")
    rows = df.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_g"), F.col(vec_col).alias("_v"))
    ok = d.isNotNull() & F.col("_g").isNotNull() & ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(d, lambda x: x != 0)
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    keyed = rows.withColumn("_k1", F.when(F.col("_ok"), F.xxhash64("_g", "_v"))).withColumn("_k2", F.when(F.col("_ok"), F.xxhash64(F.lit(1), "_g", "_v")))
    reps = keyed.where("_ok").groupBy("_k1", "_k2").agg(F.min("_id").alias("least"), F.count("*").alias("mult"), F.first("_g").alias("_g"), F.first("_v").alias("vec"))
    # groups and lengths are numbered, so that two never share a number
    reps = stored(reps.withColumn("_l", F.size("vec")), "distinct")
    groups = stored(numbered(stored(reps.select("_g", "_l").distinct(), "groups"), "part").withColumnsRenamed({"_g": "_og", "_l": "_ol"}), "parts")
    reps = reps.join(bounded(groups), (F.col("_g") == F.col("_og")) & (F.col("_l") == F.col("_ol")))
    # every distinct vector has a number; ids come back at the end
    named = stored(numbered(stored(reps.select("_k1", "_k2", "least", "mult", "part", "vec"), "vectors"), "rid"), "numbered")
    nodes = named.select("rid", "mult", "part", "vec")
    sizes = nodes.groupBy("part").agg(F.count("*").alias("size"))
    sizes = stored(sizes.withColumn("bits", F.least(F.lit(_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / cell)))).cast("int")), "sizes")
    nodes = nodes.join(sizes, "part")
    edges, todo, exact = None, None, set()
    for attempt in range(4 * tries):
        new = _start(nodes if todo is None else nodes.where(F.col("bits").isin(todo)), tables, k, floor, 17 + attempt, 4 * cell)
        lists = stored(_lists(new if edges is None else new.unionByName(edges), k), "lists")
        for _ in range(rounds):
            lists = stored(_lists(lists.unionByName(_descend(nodes, lists, k, floor)), k), "lists")
        edges = lists
        links = lists.where(F.col("sim") >= threshold)
        full = cut(links.groupBy("a").count().where(F.col("count") >= k).select(F.col("a").alias("rid")))
        some = full.count() > 0
        whole = cut(_saturated(nodes, lists, full, threshold)) if some else None
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if some:
            both = both.unionByName(whole.where("kind = 'u'").select("a", "b")).join(full.select(F.col("rid").alias("a")), "a", "left_anti")
        loose = stored(both.distinct(), "links")
        n = loose.join(nodes.select(F.col("rid").alias("b"), "mult"), "b").groupBy("a").agg(F.sum("mult").alias("n"))
        if some:
            n = n.unionByName(whole.where("kind = 'n'").groupBy("a").agg(F.sum("b").alias("n")))
        n = cut(n.withColumnRenamed("a", "rid"))
        todo = sorted({bits for (bits, _), share in audit(nodes, n, full, threshold, audit_sample).items() if share < recall})
        if attempt >= tries - 1:  # blocks of 2048 cost less than more tables, or nothing else helped
            cheap = [bits for bits in todo if (cell << bits) <= 2048 * tables * tries or attempt == 4 * tries - 1]
            exact |= set(cheap)
        todo = [bits for bits in todo if bits not in exact]
        if not todo:
            break
    if some:
        loose = loose.unionByName(whole.where("kind = 'e'").select("a", "b"))
    if exact:
        part = nodes.where(F.col("bits").isin(sorted(exact)))
        all_ = stored(_exact(part, threshold), "exact")
        loose = loose.unionByName(all_.where("kind = 'e'").select("a", "b"))
        n = n.join(part.select("rid"), "rid", "left_anti").unionByName(all_.where("kind = 'n'").groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("n")))
    comp = components(loose, "a", "b")
    of = named.select("_k1", "_k2", "rid", "mult", "least").join(n, "rid", "left").join(comp, F.col("rid") == F.col("node"), "left")
    links = (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("_n")
    of = stored(of.select("_k1", "_k2", "least", links, F.coalesce("component", "rid").alias("_c")), "counted")
    first = stored(of.groupBy("_c").agg(F.min("least").alias("_first")), "first")
    of = stored(of.join(first, "_c").select("_k1", "_k2", "_n", "_first", F.lit(True).alias("_in")), "of")
    out = keyed.select("_id", "_k1", "_k2").join(of, ["_k1", "_k2"], "left")
    component = F.when(F.col("_in"), F.col("_first")).otherwise(F.col("_id"))
    out = out.select(F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
