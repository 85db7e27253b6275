"""Near-duplicate documents by bottom-k sketches.

One hash function gives each document the ``k`` least hashes of its shingle set, its sketch.
Inverted lists of the retained values generate the overlaps of sketches, an estimate over the union
sketch filters them, and the exact Jaccard similarity of full sets verifies what is left. The links
join documents to components.

How it stays linear and whole under skew:

* documents with one and the same shingle set fold into a class first; a class is one node;
* each node is first tried with the nodes that stand for most of its lists: the members whose lists
  are longest, which in a group of copies are those with the fewest changes. These links join most
  of each group to one component, and only pairs across components are looked for from there on;
* a list of at most ``list_limit`` nodes gives its pairs. Of a longer one, nodes meet by classes of
  set sizes, as linked sets differ by a quarter of their size at most; such a part gives its pairs
  if it is of ``list_limit`` nodes at most, and nothing if it is of one component. Else it is *open*;
* a pair must have :func:`least_share` of the union sketch in common. So a node with fewer values in open
  lists than that shares a list that gives pairs with each partner it has. The others are *unsure*;
* unsure nodes meet by their full sets, of which the rarest fifth decides: two sets with 80 % in
  common share one of the rarest elements of either, whatever the order, if it is one for all. Elements
  are counted, and bit sets of those in 2, 4, ... nodes tell each task their rarity, where a bit shared
  by chance changes the order for all sets alike. Lists of these elements give their pairs as above, and
  nodes in open ones meet in blocks: the nodes of a sketch value's list, in parts of bounded size,
  meet in a task, which counts the common elements of full sets by matrix products and gives no pairs
  but a spanning set of links.

A linked pair is missed where fewer than :func:`least_share` of its union sketch are in common, with a
probability of :data:`MISS` at a similarity of 0.8; or where it only meets in blocks and
none of the :data:`BLOCK_LISTS` least values of a node is among its partner's, with a probability of
about 0.2 to the power of 8, 3e-6. All else is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_set, bits_at, bits_for, in_bits, materialize
from .graph import components
from .hashing import mix, shingle_set

#: Hashes that a sketch retains. Short shingles are in many texts, and lists of their values are long: a larger
#: sketch then tells linked pairs from chance by a larger share, and fewer nodes are unsure.
K = 24
#: Nodes up to which an inverted list gives its pairs.
LIST_LIMIT = 32
#: Nodes that a node is tried with first.
STARS = 2
#: Numbers of unsure nodes that tell the rarity of an element.
LEVELS = (2, 4, 8, 16, 64, 256)
#: Least values by which nodes meet in blocks, and nodes of a part of such a list.
BLOCK_LISTS, PART = 8, 1000
#: Probability that a linked pair has fewer common values in its union sketch than are asked for.
MISS = 2e-7


def least_share(k: int, percent: int) -> float:
    """Least share of a union sketch of ``k`` values that a linked pair must have in common: by the binomial
    distribution fewer are common with a probability of ``MISS`` at most. A third of 24 values, 17 of 40."""
    p, below = percent / 100, 0.0
    for m in range(k):
        below += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if below > MISS:
            return m / k - 1e-9
    return 1.0 - 1e-9


def _sketches(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sketch = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                prints.append(_print(s))
                sketch.append(s[:k].view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.string()), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "h", "n_shingles", "print", "sketch"],
            )

    return run


def _print(s: np.ndarray) -> str | None:
    """A set as text: its size and two 64-bit sums of hashes of its members."""
    a, b = mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s + np.uint64(2)).sum(dtype=np.uint64)
    return f"{len(s):x}-{a:x}-{b:x}" if len(s) else None


def _sets(n: int, wanted: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array(bits_at(bits, at)))
            sets = [shingle_set(t.as_py(), n) for t in batch.column("text").cast(pa.binary())]
            full = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], pa.string()), full], ["print", "full"])

    return run


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the members ``full_a`` and ``full_b`` of the sets of ``a`` and ``b``."""
    left = sets.select(F.col("node").alias("a"), F.col("full").alias("full_a"))
    right = sets.select(F.col("node").alias("b"), F.col("full").alias("full_b"))
    return pairs.join(left, "a").join(right, "b")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        lists = [t.column(c).combine_chunks() for c in ("full_a", "full_b")]
        flat, at = [x.values.to_numpy() for x in lists], [x.offsets.to_numpy() for x in lists]
        both = [len(np.intersect1d(flat[0][at[0][i] : at[0][i + 1]], flat[1][at[1][i] : at[1][i + 1]], assume_unique=True)) for i in range(len(t))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64())], ["a", "b", "n_both"])


def _verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose exact similarity is ``percent`` or more."""
    both = _common(pairs.select("a", "b"), sets).select("a", "b", "full_a", "full_b").mapInArrow(_overlap, "a long, b long, n_both long")
    na = sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"))
    nb = sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
    return both.join(na, "a").join(nb, "b").where(f"100 * n_both >= {percent} * (na + nb - n_both)").select("a", "b")


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sketches have enough of the union sketch in common and whose sizes allow a link."""
    a = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    b = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    return pairs.join(a, "a").join(b, "b").where(fits).where(shared >= least_share(k, percent) * F.size(union)).select("a", "b")


def _need(sketch: Column, k: int, percent: int) -> Column:
    """Values that a sketch must have in common with that of a linked node, at least."""
    return F.ceil(F.size(sketch) * least_share(k, percent)).cast("int")


def _size_class(n_shingles: Column, percent: int) -> Column:
    """Classes of sizes such that linked sets are of one class or of two neighbouring ones."""
    return F.floor(F.log(n_shingles.cast("double")) / math.log(100.001 / percent)).cast("int")


def _pairs_in_lists(members: DataFrame, percent: int) -> DataFrame:
    """a < b and n_lists, need, room: the pairs of the members of each list (value, cls) that are across
    components, aren't both unsure and whose sizes allow a link. In a list of a size class (cls 0 or
    more) one of a pair must be of this class, so that a pair meets once by a value. ``room`` is the
    number of values that they may share in open lists."""
    held = F.array_sort(F.collect_set(F.struct("node", "root", "n_shingles", "c", "n_open", "need")))
    lists = members.groupBy("value", "cls").agg(held.alias("m"))
    fits = f"100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)"
    other = f"y.root <> x.root and (cls < 0 or x.c = cls or y.c = cls) and (x.n_open < x.need or y.n_open < y.need) and {fits}"
    pair = "struct(x.node as a, y.node as b, greatest(x.need, y.need) as need, least(x.n_open, y.n_open) as room)"
    each = F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {other}), y -> {pair})))")
    pairs = lists.select(F.explode(each).alias("p")).select("p.*")
    return pairs.groupBy("a", "b", "need", "room").agg(F.count("*").alias("n_lists"))


_SLOT = 2654435761  # spreads size classes over the places of a bit set


def _open_counts(bits: Broadcast, n_bits: int):
    """node and n_open, the values of its sketch whose list of the node's size class is open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = batch.column("sketch")
            owner = np.repeat(np.arange(len(batch)), np.diff(sketch.offsets.to_numpy()))
            value, c = sketch.flatten().to_numpy(), batch.column("c").to_numpy().astype(np.int64)[owner]
            place = [(value & (n_bits - 1)) ^ (k * _SLOT & (n_bits - 1)) for k in (c, c + 1)]
            hit = bits_at(bits.value, place[0]) | bits_at(bits.value, place[1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.bincount(owner[hit], minlength=len(batch)).astype(np.int32))], ["node", "n_open"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the elements occur in the sets of a batch."""
    for batch in batches:
        value, n = np.unique(batch.column("full").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["value", "n"])


def _rarest(levels: Broadcast, percent: int):
    """The elements of each set that decide, less those that no other set has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, full, rare = batch.column("node").to_numpy(), batch.column("full"), []
            at = full.offsets.to_numpy()
            for i in range(len(batch)):
                s = full.values[at[i] : at[i + 1]].to_numpy()
                level = sum(bits_at(b, s & (8 * (len(b) - 4096) - 1)).astype(np.int8) for b in levels.value)
                first = np.lexsort((s, level))[: len(s) - -(-percent * len(s) // 100) + 1]
                rare.append(s[first[level[first] > 0]])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(rare, pa.list_(pa.int64()))], ["node", "rare"])

    return run


def _block_links(percent: int):
    """Links of the nodes of a (list, part, part): each node with the least node of its component there."""
    def group(rows: pa.Table) -> dict[str, np.ndarray] | None:
        node, size, c = (rows.column(x).to_numpy() for x in ("node", "n_shingles", "c"))
        full = rows.column("full").combine_chunks()
        owner = np.repeat(np.arange(len(rows)), np.diff(full.offsets.to_numpy()))
        names, code, often = np.unique(full.flatten().to_numpy(), return_inverse=True, return_counts=True)
        keep = often[code] > 1
        owner, (names, code) = owner[keep], np.unique(code[keep], return_inverse=True)
        both = np.zeros((len(rows), len(rows)), np.float32)
        for a in range(0, len(names), 1024):
            at = (code >= a) & (code < a + 1024)
            held = np.zeros((len(rows), min(1024, len(names) - a)), np.float32)
            held[owner[at], code[at] - a] = 1
            both += held @ held.T
        link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, False)
        if rows.column("ci")[0].as_py() != rows.column("cj")[0].as_py():
            link &= c[:, None] != c[None, :]
        if not link.any():
            return None
        root = np.arange(len(rows))
        while True:
            least = np.minimum(root, np.where(link, root[None, :], len(rows)).min(1))
            if (least == root).all():
                return {"a": node, "b": node[root]}
            root = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = [table.column(x).to_numpy() for x in ("value", "ci", "cj")]
            starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if (out := group(table.slice(a, b - a)) if b - a > 1 else None) is not None:
                    yield pa.RecordBatch.from_pydict(out)
            rest = table.slice(starts[-1])
        if rest is not None and len(rest) > 1 and (out := group(rest)) is not None:
            yield pa.RecordBatch.from_pydict(out)

    return run


def _links_in_blocks(unsure: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among nodes (node, n_shingles, sketch) that share one of their least values."""
    each = unsure.select("node", F.explode(F.slice("sketch", 1, BLOCK_LISTS)).alias("value"))
    crowd = each.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    k = F.ceil(F.col("n") / PART).cast("long")
    placed = each.join(crowd, "value").withColumn("k", k).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    placed = placed.select("node", "value", "c", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"))
    full = placed.join(unsure.select("node", "n_shingles"), "node").join(sets.select("node", "full"), "node")
    full = full.repartition("value", "ci", "cj").sortWithinPartitions("value", "ci", "cj")
    return full.mapInArrow(_block_links(percent), "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, k: int = K, list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; further columns are ignored).

    Returns doc_id, n_shingles, component_id, kept. Texts are split at ASCII white space with A to Z
    lower-cased; the set holds ``shingle``-word sequences, of a shorter text the whole sequence.
    Documents with a similarity of ``percent`` or more are linked; component_id is the least doc_id
    reachable. Defined cases: a null, empty or blank text has an empty set, is linked with nothing
    and is its own component; rows that repeat a doc_id belong to the component of their text; rows
    with a null doc_id never are a component's id: where all ids of a component are null,
    component_id is null and kept true; an empty table gives an empty result.
    """
    with Scratch() as scratch:
        groups = materialize(_grouped(scratch, docs, shingle, percent, k, list_limit), "groups")
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(scratch: Scratch, docs: DataFrame, shingle: int, percent: int, k: int, list_limit: int) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text"))
    rows = scratch(keyed.mapInArrow(_sketches(shingle, k), "doc_id long, h long, n_shingles long, print string, sketch array<long>"), "sketches")
    folded = rows.where("print is not null").groupBy("print").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    folded = folded.withColumns({"node": F.monotonically_increasing_id(), "c": _size_class(F.col("n_shingles"), percent)})
    nodes = scratch(folded, "nodes")
    roots = _linked(scratch, docs, nodes, shingle, percent, k, list_limit)
    named = nodes.select("print", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select("print", "component_id")
    out = rows.select("doc_id", "h", "n_shingles", "print").join(by_print, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", "print", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _linked(scratch: Scratch, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, k: int, list_limit: int) -> DataFrame:
    """node, root of every linked node."""
    entries = nodes.select("node", F.explode("sketch").alias("value"))
    lists = entries.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    held = scratch(entries.join(lists, "value"), "entries")
    # each node is tried with the nodes that stand for most of its lists
    weight = held.groupBy("node").agg(F.sum("n").alias("w"))
    reps = held.join(weight, "node").groupBy("value").agg(F.max_by("node", F.struct("w", "node")).alias("rep"))
    star = held.join(reps, "value").where("rep <> node").groupBy("node", "rep").agg(F.count("*").alias("c")).where("c > 1")
    best = star.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "rep")), asc=False), 1, STARS).alias("t"))
    star = best.select("node", F.explode("t.rep").alias("rep")).select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
    star = scratch(_estimated(star, nodes, k, percent), "stars")
    sets = _full_sets(scratch, docs, nodes, _ends(star), shingle)
    links = scratch(_verified(star, sets, nodes, percent), "links")
    scratch.done("stars", "sets")
    roots = scratch(components(links, scratch, "first"), "roots")
    # pairs across components: of short lists, and of parts of long ones by size classes
    known = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n_shingles", "c", "sketch")
    known = scratch(known, "known")
    wide = held.where(F.col("n") > list_limit).select("value", "node").join(known.select("node", "root", "c"), "node")
    wide = wide.select("value", "root", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("cls"))
    parts = wide.groupBy("value", "cls").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    parts = scratch(parts.where("lo <> hi").select("value", "cls", "n"), "parts")
    crowd = parts.where(F.col("n") > list_limit)
    n_bits = bits_for(crowd.count(), 512)  # a bit set by chance makes a node unsure for nothing
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(crowd.select(F.expr(f"(value & {n_bits - 1}L) ^ ((cls * {_SLOT}L) & {n_bits - 1}L)").alias("p")), n_bits))
    counted = known.select("node", "c", "sketch").mapInArrow(_open_counts(bits, n_bits), "node long, n_open int")
    status = scratch(known.join(counted, "node").select("node", "root", "n_shingles", "c", "n_open", _need(F.col("sketch"), k, percent).alias("need")), "status")
    unsure = scratch(status.where("n_open >= need").join(known.select("node", "sketch"), "node"), "unsure")
    at = held.join(status, "node")
    short = at.where(F.col("n") <= list_limit).withColumn("cls", F.lit(-1)).drop("n")
    split = at.where(F.col("n") > list_limit).drop("n").withColumn("cls", F.explode(F.array(F.col("c"), F.col("c") + 1)))
    split = split.join(parts.where(F.col("n") <= list_limit).select("value", "cls"), ["value", "cls"])
    pairs = _pairs_in_lists(short, percent).unionByName(_pairs_in_lists(split, percent)).groupBy("a", "b", "need", "room").agg(F.sum("n_lists").alias("n_lists"))
    pairs = scratch(_estimated(pairs.where("n_lists + room >= need").select("a", "b"), nodes, k, percent), "pairs")
    scratch.done("entries", "parts", "status", "known")
    wanted = _ends(pairs).withColumn("unsure", F.lit(False)).unionByName(unsure.select("node", F.lit(True).alias("unsure")))
    wanted = wanted.groupBy("node").agg(F.max("unsure").alias("unsure"))
    if wanted.isEmpty():
        return roots
    sets = _full_sets(scratch, docs, nodes, wanted, shingle)
    if unsure.isEmpty():
        found = links.unionByName(_verified(pairs, sets, nodes, percent))
    else:
        met, crowded = _unsure_pairs(scratch, unsure, nodes, sets, percent, k, list_limit)
        found = links.unionByName(_verified(pairs.unionByName(met).distinct(), sets, nodes, percent))
        if not crowded.isEmpty():
            found = found.unionByName(_links_in_blocks(crowded, sets, percent))
    found = scratch(found, "found")
    scratch.done("links", "pairs", "sets", "met", "crowded", "unsure")
    return components(found, scratch)


def _unsure_pairs(scratch: Scratch, unsure: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, k: int, list_limit: int) -> tuple[DataFrame, DataFrame]:
    """Pairs across components of ``unsure`` nodes that share one of the rarest elements of their full
    sets, by the estimate; and the nodes in open lists of such elements, which are to meet in blocks."""
    own = sets.where("unsure")
    often = own.select("full").mapInArrow(_counted, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where("n > 1")
    often = scratch(often, "often")
    sizes = [min(1 << 26, bits_for(n)) for n in often.agg(*(F.count_if(F.col("n") >= t) for t in LEVELS)).first()]  # 48 MB of bits at most
    levels = [bit_set(often.where(F.col("n") >= t).select(F.col("value").bitwiseAND(m - 1).alias("p")), m) for t, m in zip(LEVELS, sizes, strict=True)]
    scratch.done("often")
    levels = unsure.sparkSession.sparkContext.broadcast(levels)
    rare = own.select("node", "full").mapInArrow(_rarest(levels, percent), "node long, rare array<long>")
    rare = rare.select("node", F.explode("rare").alias("value")).join(unsure.select("node", "root", "n_shingles", "c"), "node")
    rare = scratch(rare.withColumn("cls", F.explode(F.array(F.col("c"), F.col("c") + 1))), "rare")
    lists = rare.groupBy("value", "cls").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    lists = scratch(lists.select("value", "cls", "n"), "lists")
    short = rare.join(lists.where(F.col("n") <= list_limit).select("value", "cls"), ["value", "cls"])
    met = _pairs_in_lists(short.withColumns({"n_open": F.lit(0), "need": F.lit(1)}), percent).select("a", "b")
    met = scratch(_estimated(met, nodes, k, percent), "met")
    crowded = rare.join(lists.where(F.col("n") > list_limit).select("value", "cls"), ["value", "cls"], "left_semi").select("node").distinct()
    crowded = scratch(unsure.join(crowded, "node", "left_semi").select("node", "n_shingles", "sketch"), "crowded")
    scratch.done("lists", "rare")
    return met, crowded


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _full_sets(scratch: Scratch, docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``wanted`` (node and more) with the full set of each node, made from the text of one of its documents.

    Texts are not shuffled: a bit for each hash of a wanted doc_id, 16 MB of bits at most, tells
    which texts to hash, and their sets meet the nodes by the set's print, so that a text that
    shares its bit by chance costs time, but no wrong row.
    """
    ids = scratch(nodes.select("node", "print", "least").join(wanted, "node"), "wanted")
    n_bits = bits_for(ids.count())
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(-(1 << 63)))), F.lit(n_bits))
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(ids.select(place(F.col("least")).alias("p")), n_bits))
    texts = docs.where("text is not null").select(place(F.col("doc_id").cast("long")).alias("bit"), "text")
    made = texts.mapInArrow(_sets(shingle, bits), "print string, full array<long>").join(ids.drop("least"), "print")
    return scratch(made.groupBy("print", *wanted.columns).agg(F.first("full").alias("full")).drop("print"), "sets")


def deduplicated(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates, with all its columns: that of the
    least doc_id (of several texts with this id, that of the least hash; of equal rows, one).

    Rows without a set (null, empty or blank texts) and rows with a null doc_id whose component has
    no id all stay; an empty table gives an empty result. Rows that stay for certain, by a bit for each
    (doc_id, hash) that goes or repeats, are passed on as they are; only the texts of the others meet
    the exact list of what goes.
    """
    names = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(names)))
    with Scratch() as scratch:
        groups = scratch(_grouped(scratch, plain.select("doc_id", "text"), shingle, percent, K, LIST_LIMIT), "groups")
        groups = groups.withColumn("free", F.col("kept") & (F.col("doc_id").isNull() | F.col("print").isNull()))
        each = groups.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.first("free").alias("free"), F.first("kept").alias("kept"), F.first("component_id").alias("component_id"))
        first = each.where("kept and not free").groupBy("component_id").agg(F.min(F.struct("doc_id", "h")).alias("k"))
        each = each.join(first.select("k.doc_id", "k.h", F.lit(True).alias("first")), ["doc_id", "h"], "left")
        each = each.withColumn("stays", F.col("free") | F.coalesce("first", F.lit(False)))
        doubtful = each.where("not stays or (n > 1 and not free)").select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "stays")
        doubtful = materialize(doubtful, "doubtful")
    n_bits = bits_for(doubtful.count())
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n_bits))
    seen = in_bits(bit_set(doubtful.select(place("d", "t").alias("p")), n_bits), docs.sparkSession)
    keyed = plain.withColumns({"__d": F.col("doc_id").cast("long"), "__h": F.xxhash64("text")}).withColumn("__seen", seen(place("__d", "__h")))
    rest, same = keyed.where("__seen"), F.col("__d").eqNullSafe(F.col("d")) & (F.col("__h") == F.col("t"))
    out = keyed.where("not __seen").unionByName(rest.join(doubtful, same, "left_anti"))
    repeated = doubtful.where("stays")
    if not repeated.isEmpty():
        out = out.unionByName(rest.join(repeated, same, "left_semi").dropDuplicates(["__d", "__h"]))
    return out.drop("__d", "__h", "__seen").toDF(*names)
