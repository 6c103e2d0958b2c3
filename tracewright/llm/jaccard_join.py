"""Exact Jaccard join of documents over word n-grams, in the metric space of shingle sets.

1. Equal sets are one node. Pivots of the first level are single shingles: all shingles of a set are equally near to it, so
   ties are broken by one order of all shingles (those frequent in a sample last). A set that differs from another by
   at most the threshold misses so few shingles that the first n - ceil(t n) + 1 hold a common one: this is the window in
   which a set is replicated. The least node at a shingle is its pivot document, and the regions of one pivot are merged.
2. Classes of shingles (by leading bits of their hashes) are further pivots, in the metric of symmetric differences: a set's
   distances to all of them are known from its counts per class, a sketch of a byte for about four shingles. By the triangle
   inequality the counts of linked sets differ by little, so a region keeps only sets that have such a partner in it; the
   sets themselves move only then.
3. In a region of more than LEAF sets the exact distance to the pivot is taken. Sets within half the radius are its core:
   by the triangle inequality they are all linked, and are counted without being compared. The others are cut into shells
   as wide as the radius; a set is replicated into the shell below its own, as no link spans more. Shells that are still
   too large are cut again around a pivot of their own, and what is left over is dealt into pairs of blocks.
4. Leaves compare their sets exactly. A pair that meets in several regions counts in that of its least common pivot.

Tasks return links per set and a spanning star per leaf, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, slices, small, staged, tidied
from .components import components
from .words import SPACED, grams, mix, word_shards

#: Sets that one leaf compares with each other.
LEAF = 1000
#: One document in SAMPLE is looked at for frequent shingles; those in at least FREQUENT of them are put last, MOST at most.
SAMPLE, FREQUENT, MOST = 32, 4, 1 << 17
_COLUMNS, _BAND = 2048, 256
#: Bits of the hash that names a set; sets that share a name are told apart by another hash of 64 bits.
NAME_BITS = 64
#: Bytes of names and pivots of sets that are broadcast to where the texts are; more are joined by a shuffle.
WANTED_BYTES = 16 << 20


def shingle_sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted different hashes of its runs of n words); a text of fewer words is one run, without words none."""
    for i, j, hashes, off in word_shards(col, SPACED, 1 << 19):
        every = grams(hashes, n)
        for d in range(j - i):
            a, b = off[d], off[d + 1]
            if b - a >= n:
                yield i + d, np.unique(every[a : b - n + 1])
            elif b > a:
                yield i + d, mix(grams(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield i + d, np.zeros(0, np.uint64)


def node_names(s: np.ndarray, bits: int) -> tuple[int, int]:
    """Two hashes of a set: the name it goes by (of so many bits), and the one that tells sets of one name apart."""
    h = mix(s)
    whole = np.array([h.sum(), np.bitwise_xor.reduce(h), (h * h).sum(), len(s)], np.uint64)
    name = mix(mix(mix(whole[:1]) ^ whole[1:2]) ^ whole[3:]) >> np.uint64(64 - bits)
    other = mix(mix(mix(whole[2:3]) + whole[1:2]) ^ whole[3:])
    return int(name.view(np.int64)[0]), int(other.view(np.int64)[0])


def _counts(s: np.ndarray) -> bytes:
    """Shingles of a set in each of a power of two of classes, about four in a class; 255 stands for more."""
    bits = max(2, int(len(s) // 4).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _partners(size: np.ndarray, sketch: list[bytes], barred: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may have a linked one among the others: barred pairs aside, their class counts differ by no more than the
    symmetric difference of linked sets of their sizes. Classes are merged where one of two has half as many."""
    out = np.zeros(len(size), bool)
    width = np.array([len(x) for x in sketch])
    for w in np.unique(width):
        a, b = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        at = np.concatenate([a, b])
        if len(at) < 2:
            continue
        x = np.array([np.frombuffer(sketch[i], np.uint8) for i in a], np.int16)
        if len(b):
            y = np.array([np.frombuffer(sketch[i], np.uint8) for i in b], np.int16)
            x = np.concatenate([x, y.reshape(len(b), w, 2).sum(2, dtype=np.int16)])
        for i in range(len(a)):
            apart = np.abs(x[i + 1 :] - x[i]).sum(1, dtype=np.int64)
            near = apart * (100 + percent) <= (size[at[i + 1 :]] + size[at[i]]) * (100 - percent)
            near &= ~barred[at[i], at[i + 1 :]]
            if near.any():
                out[at[i]] = True
                out[at[i + 1 :][near]] = True
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (whole numbers below 2**24), a band of members at a time."""
    k = len(sets)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((k, k), np.float32)
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
        i, j = np.searchsorted(code, [a, a + _COLUMNS])
        x = np.zeros((k, _COLUMNS if j < len(code) else int(code[-1]) + 1 - a), np.float32)
        x[owner[i:j], code[i:j] - a] = 1
        out += x @ x.T
    return out


def _met_before(pivots: list[np.ndarray], pivot: int) -> np.ndarray | None:
    """Which pairs of sets share a pivot below this one, where they count; None if no set has one."""
    lower = [p[p < pivot] for p in pivots]
    if not any(map(len, lower)):
        return None
    return _common(lower) > 0


#: Of sizes, sketches and barred pairs: which sets may have a linked one among the others.
Partners = Callable[[np.ndarray, list[bytes], np.ndarray], np.ndarray]


def _kept(partners: Partners):
    """Of rows (pivot, cell, side, node, core, n, sketch, pivots) sorted by cell: pivot and node of those that have a partner
    which they meet in no region before."""
    schema = pa.schema([("pivot", pa.int64()), ("node", pa.int64())])

    def run(batches):
        out: list[tuple] = []
        total = 0
        for held in _groups(batches):
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows < 2:
                continue
            get = lambda c: rows.column(c).chunk(0)  # noqa: B023, E731
            side, core, node = (get(c).to_numpy() for c in ("side", "core", "node"))
            barred = (core[:, None] == core[None, :]) & (core != 0)[:, None]
            if side.any():
                barred |= side[:, None] == side[None, :]
            if (before := _met_before(_lists(get("pivots")), rows.column("pivot")[0].as_py())) is not None:
                barred |= before
            keep = partners(get("n").to_numpy(), get("sketch").to_pylist(), barred)
            if keep.any():
                out.append((np.full(int(keep.sum()), rows.column("pivot")[0].as_py(), np.int64), node[keep]))
                total += len(out[-1][1])
            if total > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)
                out, total = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def _nearby(partners: Partners):
    """Rows (pivot, node, n, sketch, pivots, n and sketch of the pivot): whether the row and its pivot may be linked."""

    def run(batches):
        for batch in batches:
            p, n, s, m, t = (batch.column(k).to_pylist() for k in (0, 2, 3, 5, 6))
            near = [bool(partners(np.array([a, b]), [x, y], np.zeros((2, 2), bool))[0]) for a, x, b, y in zip(n, s, m, t, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([a if k else 0 for a, k in zip(p, near, strict=True)], pa.int64())], names=["pivot", "node", "n", "sketch", "pivots", "core"])

    return run


def filtered(member: DataFrame, sketches: DataFrame, partners: Partners) -> DataFrame:
    """The memberships whose set may have a linked one in the region. In a large region, sets that may be linked with the
    pivot are kept at once, and never compared with each other here."""
    columns = ["pivot", "cell", "side", "node", "core", "n", "sketch", "pivots"]
    sketches = sketches.join(member.groupBy("node").agg(F.sort_array(F.collect_list("pivot")).alias("pivots")), "node")
    start = {"cell": F.lit(0).cast("long"), "side": F.lit(0)}
    large = staged(member.groupBy("pivot").count().filter(F.col("count") > LEAF).select("pivot"), "large")
    if not large.count():
        rows = member.join(sketches, "node").withColumns(start | {"core": F.lit(0).cast("long")}).select(*columns)
        near = None
    else:
        rows = member.join(large, "pivot", "left_anti").join(sketches, "node").withColumns(start | {"core": F.lit(0).cast("long")}).select(*columns)
        far = member.join(large, "pivot").join(sketches, "node").join(sketches.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("sketch").alias("t")), "pivot").select("pivot", "node", "n", "sketch", "pivots", "m", "t")
        far = staged(far.mapInArrow(tidied(_nearby(partners)), "pivot long, node long, n long, sketch binary, pivots array<long>, core long"), "near").withColumns(start)
        rows = rows.unionByName(_blocks(far.select(*columns), _sizes(far), columns))
        near = far.filter("core <> 0").select("pivot", "node")
    kept = rows.repartition("pivot", "cell").sortWithinPartitions("pivot", "cell").mapInArrow(tidied(_kept(partners)), "pivot long, node long")
    return (kept.unionByName(near) if near is not None else kept).distinct()


def _sizes(rows: DataFrame) -> DataFrame:
    core = F.col("core") == F.col("pivot")
    return rows.groupBy("pivot", "cell").agg(F.count_if(core).alias("core_rows"), F.count_if(~core).alias("rest_rows"))


def _sketch(n: int, percent: int, frequent, bits: int):
    def run(batches):
        seen = set()
        last = frequent.value
        for batch in slices(batches):
            size, node, other, prefix, sketch = np.zeros(batch.num_rows, np.int64), *([None] * batch.num_rows for _ in range(4))
            for row, s in shingle_sets(batch.column(2), n):
                if size_ := len(s):
                    size[row], (node[row], other[row]) = size_, (names := node_names(s, bits))
                    if names not in seen:
                        seen.add(names)
                        sketch[row] = _counts(s)
                        if len(last):
                            late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                            s = np.concatenate([s[~late], s[late]])
                        prefix[row] = s[: size_ + (-percent * size_ // 100) + 1].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "said", "n_shingles", "node", "other", "prefix", "sketch"])

    return run


def told_apart(sig: DataFrame) -> DataFrame:
    """sig, where sets of different content that share a name go by their other hash. So sets are told apart by 128 bits."""
    both = sig.filter("node is not null").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y"))
    clash = staged(both.filter("x <> y").select("node", F.lit(True).alias("clash")), "clash")
    if clash.isEmpty():
        return sig
    return staged(join_small(sig, clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.col("other")).otherwise(F.col("node"))).drop("clash"), "sketch")


def _sets(n: int, bits: int):
    """Of (rep, node, ..., text): the rows whose text has that node's set, which replaces the text."""

    def run(batches):
        for batch in slices(batches):
            node, found, at = batch.column(1).to_pylist(), [], []
            for row, s in shingle_sets(batch.column(batch.num_columns - 1), n):
                if len(s) and node[row] in node_names(s, bits):
                    at.append(row)
                    found.append(s.view(np.int64))
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:-1], pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[1:-1], "shingles"])

    return run


def _lists(col: pa.Array) -> list[np.ndarray]:
    values, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [values[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def _distance(batches):
    """Distance of the last two columns' sets, which stand for it."""
    for batch in slices(batches):
        x, y = _lists(batch.column(batch.num_columns - 2)), _lists(batch.column(batch.num_columns - 1))
        common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y, strict=True)]
        d = [1 - c / (len(a) + len(b) - c) for a, b, c in zip(x, y, common, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(d, pa.float64())], names=[*batch.schema.names[:-2], "distance"])


def _leaf(rows: pa.Table, percent: int) -> dict | None:
    """Links of the sets of one leaf, and the least set that each is joined to within it."""
    node = rows.column("node").to_numpy()
    if len(node) < 2:
        return None
    first = np.unique(node, return_index=True)[1]
    if len(first) < len(node):
        rows = rows.take(pa.array(first))
        node = rows.column("node").to_numpy()
    k = len(node)
    if k < 2:
        return None
    rows = rows.combine_chunks()
    get = lambda name: rows.column(name).chunk(0)
    sets = _lists(get("shingles"))
    size = np.array([len(s) for s in sets])
    window, core, side, weight, pivot = (get(c).to_numpy() for c in ("window", "core", "side", "weight", "pivot"))
    common = _common(sets)
    link = np.zeros((k, k), bool)
    for a in range(0, k, _BAND):  # of wide numbers, only a band of rows is held
        b = slice(a, a + _BAND)
        shared = common[b].astype(np.int64)
        link[b] = 100 * shared >= percent * (size[b, None] + size[None, :] - shared)
        link[b] &= (window[b, None] & window[None, :]) == 0
        link[b] &= (core[b, None] != core[None, :]) | (core[b] == 0)[:, None]
        if side.any():
            link[b] &= side[b, None] != side[None, :]
    np.fill_diagonal(link, False)
    del common
    if not link.any():
        return None
    if (before := _met_before(_lists(get("pivots")), int(pivot[0]))) is not None:
        link &= ~before
    at = np.flatnonzero(link.any(1))
    if not len(at):
        return None
    link = link[np.ix_(at, at)]
    bands = [slice(a, a + _BAND) for a in range(0, len(at), _BAND)]
    links = np.concatenate([(link[b] * weight[at][None, :]).sum(1) for b in bands])
    near = link | np.eye(len(at), dtype=bool)
    root = node[at].copy()
    while True:
        new = np.concatenate([np.where(near[b], root[None, :], np.iinfo(np.int64).max).min(1) for b in bands])
        if (new == root).all():
            break
        root = new
    return {"node": node[at], "links": links.astype(np.int64), "root": root}


def _groups(batches):
    """Runs of rows of one cell; they may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        p, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(c) != 0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (int(p[a]), int(c[a])):
                yield held
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _leaves(percent: int):
    """Links and stars of all leaves, over rows sorted by leaf."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        out: list[dict] = []
        for held in _groups(batches):
            if (found := _leaf(pa.Table.from_batches(held), percent)) is not None:
                out.append(found)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[f.name] for x in out])) for f in schema], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[f.name] for x in out])) for f in schema], schema=schema)

    return run


_ROW = ["pivot", "cell", "side", "window", "node", "weight", "pivots", "core", "shingles"]
_ROW_TYPES = "pivot long, cell long, side int, window int, node long, weight long, pivots array<long>, core long, shingles array<long>"


def _shells(rows: DataFrame, eps: float, level: int) -> DataFrame:
    """Rows with a distance, each in its own shell and as a window row in the one below."""
    shell = F.floor(F.col("distance") / F.lit(eps * (1 + 1e-9))).cast("int")
    both = F.array(F.struct(shell.alias("s"), F.lit(0).alias("w")), F.struct((shell - 1).alias("s"), F.lit(1 << level).alias("w")))
    rows = rows.withColumn("__to", F.explode(F.filter(both, lambda x: x["s"] >= 0)))
    return rows.withColumns({"cell": F.xxhash64("cell", "__to.s"), "shell": F.col("__to.s"), "window": F.col("window").bitwiseOR(F.col("__to.w"))}).drop("__to", "distance")


def _blocks(rows: DataFrame, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of cells that are still too large, dealt to pairs of blocks; two blocks of core sets never meet."""
    is_core = F.col("core") == F.col("pivot")
    n_core, n_rest = (F.ceil(F.col(c) / LEAF).cast("int") for c in ("core_rows", "rest_rows"))
    own = F.when(is_core, F.pmod(F.hash("node"), F.greatest(n_core, F.lit(1)))).otherwise(F.lit(1_000_000) + F.pmod(F.hash("node"), F.greatest(n_rest, F.lit(1))))
    up_to = lambda n, start: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i + start)).otherwise(F.array().cast("array<int>"))
    other = F.concat(F.when(is_core, F.array().cast("array<int>")).otherwise(up_to(n_core, 0)), up_to(n_rest, 1_000_000))
    rows = rows.join(sizes, ["pivot", "cell"]).withColumn("__own", own).withColumn("__other", F.explode(other))
    return rows.withColumns({"cell": F.xxhash64("cell", F.least("__own", "__other"), F.greatest("__own", "__other")), "side": F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") < F.col("__other"), 1).otherwise(2)}).select(*columns)


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text): doc_id, said (hash of the text), n_shingles and node of every row, node being its set's name (null
    for none); and node, root (of its component), component_id and n_links of every set."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sampled(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(s.view(np.int64) for _, s in shingle_sets(batch.column(0), n))]))], names=["s"])

    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tidied(sampled), "s long")
    often = few.groupBy("s").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(MOST).toArrow()
    frequent = sc.broadcast(np.sort(np.asarray(often.column("s")).astype(np.int64).view(np.uint64)))

    said = docs.select("doc_id", F.xxhash64("text").alias("said"), "text")
    sig = said.mapInArrow(tidied(_sketch(n, percent, frequent, NAME_BITS)), f"doc_id {kind}, said long, n_shingles long, node long, other long, prefix array<long>, sketch binary")
    sig = told_apart(staged(sig, "sketch"))
    at = sig.filter("prefix is not null").select("node", F.explode("prefix").alias("shingle")).repartition("shingle")
    leaders = at.groupBy("shingle").agg(F.min("node").alias("pivot"), F.max("node").alias("__top")).filter(F.col("pivot") != F.col("__top")).drop("__top")
    member = staged(at.join(leaders, "shingle").select("pivot", "node").distinct(), "member")

    sketches = sig.filter("sketch is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    member = staged(filtered(member, staged(sketches, "sketches"), partial(_partners, percent=percent)), "kept")
    return linked_sets(docs, sig, member, n, percent)


def linked_sets(docs: DataFrame, sig: DataFrame, member: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What _classes returns, from sig (doc_id, said, n_shingles, node) and member (pivot, node), the regions in which sets
    may be linked: they are compared exactly there, large ones around their pivots. A pivot is a set of its own region."""
    eps = 1 - percent / 100
    classes = sig.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))
    needed = staged(member.groupBy("node").agg(F.sort_array(F.collect_list("pivot")).alias("pivots")).join(classes, "node").select("rep", "node", "weight", "pivots"), "needed")
    width = 32 + 8 * F.size("pivots") + F.coalesce(F.octet_length(F.col("rep").cast("string")), F.lit(0))
    n_needed, n_bytes = needed.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    wanted = F.broadcast(needed) if n_bytes <= WANTED_BYTES else needed
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("rep", "node", "weight", "pivots", "text")
    sets = staged(texts.mapInArrow(tidied(_sets(n, NAME_BITS)), "node long, weight long, pivots array<long>, shingles array<long>"), "sets")
    if sets.count() > n_needed:  # rows that repeat an id and its text
        sets = staged(sets.dropDuplicates(["node"]), "sets")

    counts = member.groupBy("pivot").count()
    large = staged(counts.filter(F.col("count") > LEAF).select("pivot"), "large")
    small = member.join(large, "pivot", "left_anti") if (any_large := large.count() > 0) else member
    start = {"cell": F.lit(0).cast("long"), "side": F.lit(0), "window": F.lit(0)}
    extra = None
    if any_large:
        shingles = sets.select("node", "shingles")
        far = member.join(large, "pivot").join(shingles, "node").join(shingles.withColumnsRenamed({"node": "pivot", "shingles": "at"}), "pivot")
        far = staged(far.select("pivot", "node", "shingles", "at").mapInArrow(tidied(_distance), "pivot long, node long, distance double"), "distance")
        core = far.filter(F.col("distance") <= eps / 2 * (1 - 1e-9)).groupBy("node").agg(F.min("pivot").alias("core"))
        sets = staged(sets.join(core, "node", "left").withColumn("core", F.coalesce("core", F.lit(0).cast("long"))), "cored")
        leaves = small.join(sets, "node").withColumns(start).select(*_ROW)
        shells = staged(_shells(far.join(sets, "node").withColumns(start), eps, 0).select(*_ROW, "shell"), "shells")
        leaves = leaves.unionByName(_smaller(shells, sets, eps))
        extra = sets.filter("core <> 0").select("node", "weight", F.col("core").alias("root"))
        mass = extra.groupBy("root").agg(F.sum("weight").alias("mass"))
        extra = extra.join(mass, "root").select("node", (F.col("mass") - F.col("weight")).alias("links"), "root")
    else:
        leaves = small.join(sets, "node").withColumns(start | {"core": F.lit(0).cast("long")}).select(*_ROW)
    found = leaves.repartition("pivot", "cell").sortWithinPartitions("pivot", "cell").mapInArrow(tidied(_leaves(percent)), "node long, links long, root long")
    found = staged(found.unionByName(extra) if extra is not None else found, "links")

    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    result = named.join(least, "root").join(links, "node", "left").select("node", "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return sig.select("doc_id", "said", "n_shingles", "node"), staged(result, "classes")


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, its own included) and n_links of every row.

    Two documents link if 100 * shared >= percent * all of their different word n-grams. A text of fewer than n words is
    one shingle; null texts and texts without words have none and link with nothing. Rows with equal sets link with each
    other. A null doc_id takes part but names no component; repeated rows are each reported. Columns of docs other than
    these two play no part. Any group size is exact: nothing is capped.
    """
    rows, result = _classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n, percent)
    out = rows.join(result, "node", "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def _smaller(shells: DataFrame, sets: DataFrame, eps: float) -> DataFrame:
    """Leaves of at most about LEAF rows from shells of any size: outer shells are cut once more, then blocks are paired."""
    key = ["pivot", "cell"]
    sizes = staged(shells.groupBy(*key, "shell").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "pivot")).alias("q")), "sizes")
    outer = sizes.filter((F.col("n") > LEAF) & (F.col("shell") > 0))
    done = shells.join(outer.select(*key), key, "left_anti")
    if outer.count():
        q = outer.join(sets.select(F.col("node").alias("q"), F.col("shingles").alias("at")), "q").select(*key, "at")
        again = shells.join(q, key).select(*_ROW, F.col("shingles").alias("own"), "at").mapInArrow(tidied(_distance), _ROW_TYPES + ", distance double")
        done = done.unionByName(_shells(again, eps, 1).select(*_ROW, "shell"))
        done = staged(done, "shells")
    of = staged(_sizes(done).filter(F.col("core_rows") + F.col("rest_rows") > LEAF), "over")
    rest = done.join(of.select(*key), key, "left_anti").select(*_ROW)
    return rest.unionByName(_blocks(done.select(*_ROW), of, _ROW))


def distinct_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each group of linked ones: that of the least doc_id, null ids last, and of the rows with that id
    the one whose text has the least hash; of rows that repeat both, any one. Rows without words all stay."""
    rows, result = _classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n, percent)
    rows = rows.filter("node is not null").groupBy("node", "doc_id", "said").agg(F.count("*").alias("times"))
    rows = staged(rows.join(result.select("node", "root"), "node").select("root", "doc_id", "said", "times"), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("said").alias("c"))
    least = rows.groupBy("root").agg(F.min(first).alias("first"))
    gone = staged(rows.join(least, "root").filter(first != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("said").alias("__said")), "gone")
    again = staged(rows.join(least, "root").filter((first == F.col("first")) & (F.col("times") > 1)).select(F.col("doc_id").alias("__id"), F.col("said").alias("__said")), "again")
    key = [F.col(doc_id).eqNullSafe(F.col("__id")), F.xxhash64(text) == F.col("__said")]
    kept = docs.join(small(gone), key, "left_anti")
    if again.isEmpty():
        return kept
    one = kept.join(small(again), key, "left_semi").withColumn("__said", F.xxhash64(text)).dropDuplicates([doc_id, "__said"]).drop("__said")
    return kept.join(small(again), key, "left_anti").unionByName(one)
