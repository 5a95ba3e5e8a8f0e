"""Near-duplicate join of documents on word shingles by a MinHash LSH forest.

1. Documents of one shingle set form a class with a number of its own; ids, which may be null or repeated, only name results.
2. A class has a label of ``LONGEST`` MinHash values in each of ``TREES`` tries.  The forest is searched
   from its leaves: first, classes that share a whole label are compared.  Then prefixes are shortened,
   as far as the similarities met so far ask for (``shorten``): what has been found at each similarity,
   divided by the probability of finding it, gives the number of links that exist, and so the recall
   that a shorter prefix would reach.  Shortening ends at the target recall, or at the prefix
   that reaches it even if all links were at the threshold (``depth``).
3. In each step a trie is a sorted table: by node (the shortened prefix), then by child (the prefix of
   the step before).  Runs of one node with several children are cut into blocks of ``BLOCK``;
   a node whose members all stand below one child has nothing new and drops out.  A *unit* is a block,
   or two blocks of one node.  Its kernel compares signatures of pairs that no
   longer prefix and no earlier trie has brought together, and passes on the members that have a
   likely partner, not the pairs.
4. Members meet again in their units with whole shingle sets, where similarity is exact.
   What leaves is a row per member: its number of links, and the least member it is connected to.
5. Groups are the connected components of those rows.

A node with many members becomes many units of bounded size over many tasks; copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, kernel, mix64, stored
from .components import components
from .shingles import Shingler

THRESHOLD = 0.8
TREES = 24
LONGEST = 10
RECALL = 0.99999
BLOCK = 256
#: Ids of possible partners up to this number (16 MB) are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Similarities from the threshold to 1 are counted in this many steps.
BINS = 20

_A = (mix64(np.arange(1, TREES * LONGEST + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(1001, TREES * LONGEST + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chance(similarity, d: int):
    """The probability that a pair shares a prefix of ``d`` values in some trie."""
    return 1 - (1 - similarity**d) ** TREES


def depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of just the threshold's similarity meets with the target recall."""
    d = LONGEST
    while d > 1 and chance(threshold, d) < recall:
        d -= 1
    return d


def shorten(found: np.ndarray, d: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix, ``d`` values or shorter, that reaches the target recall, given the likely links found at ``d`` by similarity.

    Links of a similarity number what was found of them over the chance of finding one; one link at the
    threshold is always taken to exist.
    """
    at = threshold + (1 - threshold) * np.arange(BINS) / BINS  # the least similarity of each step
    exist = found / chance(at, d)
    exist[0] += 1
    floor = depth(threshold, recall)
    while d > floor and (exist * chance(at, d)).sum() < recall * exist.sum():
        d -= 1
    return d


def margin(threshold: float = THRESHOLD) -> float:
    """Five standard errors of the signature's estimate at the threshold."""
    return 5 * (threshold * (1 - threshold) / (TREES * LONGEST)) ** 0.5


def signature(shingles: np.ndarray) -> np.ndarray:
    """``TREES * LONGEST`` MinHash values of 16 bits, tree by tree."""
    low = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 4096):
            np.minimum(low, (h[i : i + 4096, None] * _A + _B).min(0), out=low)
        return ((low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def nodes(signatures: np.ndarray, d: int) -> np.ndarray:
    """The node of each signature (rows) in each trie at depth ``d``, as 64-bit hashes that tell tries apart."""
    labels = signatures.reshape(len(signatures), TREES, LONGEST)
    out = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), labels.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(d):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, k])
    return out


def place(docs: DataFrame) -> Column:
    """A hash of a row's id and text, by which rows are found again where ids are null or repeated."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))


def with_signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, place, key, size, sig``: identity of the shingle set, its number of shingles, its signature (null if empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("sig", pa.binary())])

    def run(batches):
        shingler = Shingler()
        for b in batches:
            keys, sizes, sigs = [], [], []
            for text in b.column("text").to_pylist():
                s = shingler.distinct(text)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield batch(schema, b.column("doc_id"), b.column("place"), keys, sizes, sigs)

    whole = id_text(docs)
    return kernel(whole.withColumn("place", place(whole)), run, "doc_id long, place long, key binary, size int, sig binary")


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of equal values in a sorted stream."""
    held: list[pa.RecordBatch] = []
    value = None
    for b in batches:
        v = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and v[i] != value:
                yield pa.Table.from_batches(held)
                held = []
            value = v[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _whole_units(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.Table]:
    """Tables of some whole units of two rows or more."""
    held, n = [], 0
    for g in _groups(batches, "unit"):
        if g.num_rows < 2:
            continue
        held.append(g)
        n += g.num_rows
        if n >= most:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), TREES * LONGEST)


def _pairs(unit: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers to compare, in arrays of bounded size: all pairs of a unit of one block, those across in a unit of two."""
    cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
    sizes = np.diff(cuts)
    two = cuts[:-1][sizes == 2]
    two = two[(side[two] == 0) | (side[two + 1] == 0)]
    for k in range(0, len(two), 1 << 14):
        yield two[k : k + (1 << 14)], two[k : k + (1 << 14)] + 1
    for a, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = side[a : a + n]
        if not own.any():
            i, j = np.triu_indices(n, 1)
        else:
            x, y = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
            i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        for k in range(0, len(i), 1 << 14):
            yield i[k : k + (1 << 14)] + a, j[k : k + (1 << 14)] + a


def _new(now: np.ndarray, before: np.ndarray | None, tree: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair of a trie's unit has met at no longer prefix, nor in an earlier trie at this one."""
    met = now[i] == now[j]
    first = met.argmax(1) == tree[i]
    if before is not None:
        first &= ~(before[i] == before[j]).any(1)
    return first


def _likely(rows: pa.Table, low: int, high: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a likely partner, and the number of likely pairs by similarity."""
    sig, unit, side, tree = _signatures(rows.column("sig")), *(rows.column(c).to_numpy() for c in ("unit", "side", "tree"))
    now, before = nodes(sig, low), None if high is None else nodes(sig, high)
    likely, found = np.zeros(len(sig), bool), np.zeros(BINS, np.int64)
    for i, j in _pairs(unit, side):
        new = _new(now, before, tree, i, j)
        i, j = i[new], j[new]
        alike = (sig[i] == sig[j]).mean(1)
        ok = alike >= threshold - margin(threshold)
        likely[i[ok]] = likely[j[ok]] = True
        step = ((alike[ok] - threshold) * BINS / max(1 - threshold, 1e-9)).astype(np.int64)
        found += np.bincount(np.clip(step, 0, BINS - 1), minlength=BINS)
    return likely, found


def _verified(rows: pa.Table, low: int, high: int | None, threshold: float) -> list[tuple]:
    """(class, linked documents, linked classes, least connected class) of the members of a unit with a link."""
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
    sig, unit, side, tree, copies, ids = _signatures(rows.column("sig")), *(rows.column(c).to_numpy() for c in ("unit", "side", "tree", "copies", "rep"))
    now, before = nodes(sig, low), None if high is None else nodes(sig, high)
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    docs, classes = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in _pairs(unit, side):
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        new = _new(now, before, tree, i, j) & (small >= threshold * large)
        for i, k in zip(i[new].tolist(), j[new].tolist(), strict=True):  # noqa: B020, PLW2901
            at = np.searchsorted(sets[i], sets[k])
            at[at == sizes[i]] = 0
            common = int(np.count_nonzero(sets[i][at] == sets[k]))
            if common >= threshold * (sizes[i] + sizes[k] - common):
                docs[i] += copies[k]
                docs[k] += copies[i]
                classes[i] += 1
                classes[k] += 1
                a, b = find(i), find(k)
                if ids[a] > ids[b]:
                    a, b = b, a
                root[b] = a
    return [(int(ids[i]), int(docs[i]), int(classes[i]), int(ids[find(i)])) for i in np.flatnonzero(classes)]


def _trie(classes: DataFrame, low: int, high: int | None) -> DataFrame:
    """``rep, tree, node, child, block``: tries as sorted tables, nodes cut into blocks; nodes that one partition sees whole, with one member or child, are left out."""
    leaf = pa.schema([("node", pa.int64()), ("child", pa.int64()), ("rep", pa.int64()), ("tree", pa.int32())])

    def plant(batches):
        for b in batches:
            n = b.num_rows
            if n:
                sig, reps = _signatures(b.column("sig")), np.repeat(b.column("rep").to_numpy(), TREES)
                children = reps if high is None else nodes(sig, high).view(np.int64).ravel()
                yield batch(leaf, nodes(sig, low).view(np.int64).ravel(), children, reps, np.tile(np.arange(TREES, dtype=np.int32), n))

    cut = pa.schema([("rep", pa.int64()), ("tree", pa.int32()), ("node", pa.int64()), ("child", pa.int64()), ("block", pa.int64())])

    def runs(batches):
        """Columns of rows that belong to one partition: a batch's last run waits for the next batch."""
        held = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            start = int(np.searchsorted(cols[0], cols[0][-1]))
            if len(cols[0]) - start > 8 * BLOCK:  # a long run is cut at whole blocks
                start += (len(cols[0]) - start) // BLOCK * BLOCK
            held = [c[start:] for c in cols]
            if start:
                yield [c[:start] for c in cols], False
        if held is not None:
            yield held, True

    def cut_blocks(batches):
        at_edge, before = True, None
        for (node, child, rep, tree), last in runs(batches):
            if not len(node):
                continue
            new = np.concatenate([[True], node[1:] != node[:-1]])
            heads = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            sizes = np.diff(np.append(heads, len(node)))
            kinds = np.add.reduceat(np.concatenate([[0], (child[1:] != child[:-1]).astype(np.int64)]) * ~new, heads)
            keep = kinds > 0
            keep[0] |= at_edge or node[0] == before
            keep[-1] |= last or sizes[-1] >= 8 * BLOCK
            at_edge, before = False, node[-1]
            place = (np.arange(len(node)) - heads[run]) // BLOCK
            first = heads[run] + place * BLOCK
            block = mix64(node.view(np.uint64) ^ mix64(rep[first].view(np.uint64) ^ mix64(child[first].view(np.uint64)))).view(np.int64)
            at = np.flatnonzero(keep[run])
            for i in range(0, len(at), 1 << 14):
                k = at[i : i + (1 << 14)]
                yield batch(cut, rep[k], tree[k], node[k], child[k], block[k])

    leaves = kernel(classes.where("sig is not null").select("rep", "sig"), plant, "node long, child long, rep long, tree int")
    tries = leaves.repartitionByRange("node", "child", "rep").sortWithinPartitions("node", "child", "rep")
    return kernel(tries, cut_blocks, "rep long, tree int, node long, child long, block long")


def _search(classes: DataFrame, low: int, high: int | None, threshold: float) -> tuple[DataFrame, np.ndarray]:
    """One step of the search: ``unit, rep, copies, tree, side, sig`` of members with a likely partner that is new at depth ``low``; likely pairs by similarity."""
    cut = stored(_trie(classes, low, high))
    blocks = cut.groupBy("node", "block").agg(F.min("child").alias("least"), F.max("child").alias("most"))
    others = blocks.select("node", F.col("block").alias("other"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    # Blocks below one child have met at a longer prefix.
    meet = blocks.join(others, "node").where("least <> most or least2 <> most2 or least <> least2").select("node", "block", "other")
    dealt = cut.join(meet, ["node", "block"])
    dealt = dealt.select("rep", "tree", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    members = dealt.join(classes.select("rep", "copies", "sig"), "rep").repartition("unit").sortWithinPartitions("unit")
    names = ["unit", "rep", "copies", "tree", "side", "sig"]
    schema = pa.schema([("unit", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("tree", pa.int32()), ("side", pa.int32()), ("sig", pa.binary()), ("found", pa.list_(pa.int64()))])

    def compare(batches):
        for rows in _whole_units(batches):
            keep, found = _likely(rows, low, high, threshold)
            if keep.any():
                out = rows.filter(pa.array(keep)).select(names).combine_chunks().to_batches()[0]
                yield batch(schema, *out.columns, [found.tolist(), *([None] * (out.num_rows - 1))])

    step = stored(kernel(members.select(*names), compare, "unit long, rep long, copies long, tree int, side int, sig binary, found array<long>"))
    found = np.zeros(BINS)
    for r in step.where("found is not null").select(F.posexplode("found").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        found[r["k"]] = r["n"]
    return step.drop("found"), found


def _linked(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of all rows; ``key, group, least, copies, docs, classes`` of all classes, ``least`` being the ``doc_id, place`` of a class's least row."""
    whole = id_text(docs)
    signed = stored(with_signatures(whole))
    classes = stored(signed.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig")).withColumn("rep", F.monotonically_increasing_id()))
    steps: list[tuple[DataFrame, int, int | None]] = []
    low, high, found = LONGEST, None, np.zeros(BINS)
    while True:
        likely, more = _search(classes, low, high, threshold)
        steps.append((likely, low, high))
        found += more
        high, low = low, shorten(found, low, threshold)
        if low == high:
            break
    reps = steps[0][0].select("rep")
    for likely, _, _ in steps[1:]:
        reps = reps.union(likely.select("rep"))
    wanted = stored(classes.join(reps.distinct(), "rep", "left_semi").select("rep", "key", F.col("least.place").alias("place")))
    places = wanted.select("place").distinct()
    if wanted.count() <= BROADCAST_IDS:
        places = F.broadcast(places)
    set_schema = pa.schema([("key", pa.binary()), ("set", pa.binary())])

    def again(batches):
        shingler = Shingler()
        for b in batches:
            sets = [shingler.distinct(t).tobytes() for t in b.column("text").to_pylist()]
            yield batch(set_schema, [xxhash.xxh3_128_digest(x) for x in sets], sets)

    again_sets = kernel(whole.withColumn("place", place(whole)).join(places, "place", "left_semi").select("text"), again, "key binary, set binary")
    sets = again_sets.join(wanted.select("key", "rep"), "key").select("rep", "set").dropDuplicates(["rep"])
    if len(steps) > 1:
        sets = stored(sets)
    link_schema = pa.schema([("rep", pa.int64()), ("docs", pa.int64()), ("classes", pa.int64()), ("root", pa.int64())])

    def verify(low, high):
        def run(batches):
            for g in _groups(batches, "unit"):
                if g.num_rows > 1 and (linked := _verified(g.combine_chunks(), low, high, threshold)):
                    yield batch(link_schema, *map(list, zip(*linked, strict=True)))

        return run

    links = None
    for likely, low, high in steps:
        units = likely.join(sets, "rep").repartition("unit").sortWithinPartitions("unit")
        own = kernel(units.select("unit", "rep", "copies", "tree", "side", "sig", "set"), verify(low, high), "rep long, docs long, classes long, root long")
        links = own if links is None else links.union(own)
    links = stored(links)
    roots = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    totals = links.groupBy("rep").agg(F.sum("docs").alias("docs"), F.sum("classes").alias("classes"))
    known = classes.select("key", "rep", "least", "copies").join(totals, "rep", "left").join(roots.withColumnRenamed("vertex", "rep"), "rep", "left")
    return signed.select("doc_id", "key"), known.withColumn("group", F.coalesce("root", "rep"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All documents with their groups of similar ones, one row per input row.

    ``doc_id``; ``class_id``: the least id of its connected group at Jaccard similarity ``threshold``
    of five-word shingles; ``rep_id``: the least id with the same shingle set; ``n_links``: other
    documents at or above the threshold, copies included; ``n_class_links``: the same, one for
    each shingle set.

    Words are lower-cased and set apart by white space; a text of fewer than five words is one
    shingle; texts without words (null, empty, blank) are copies of each other and of nothing else.  A
    null id counts as the least id and is returned null; an empty table gives none.  Rows of one id, or
    without one, are compared like any others; groups with the same least id share its ``class_id``.
    """
    signed, known = _linked(docs, threshold)
    first = known.groupBy("group").agg(F.min("least").alias("first")).select("group", F.col("first.doc_id").alias("class_id"))
    out = signed.join(known.join(first, "group"), "key")
    return out.select(
        "doc_id", "class_id", F.col("least.doc_id").alias("rep_id"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("classes", F.lit(0)).alias("n_class_links"),
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each connected group, all columns: the one with the least id, and of several with that id and different texts one.

    Groups are told apart by their texts alone, so rows of one id, or without one, stay if no row is similar to them.
    """
    least = _linked(docs, threshold)[1].groupBy("group").agg(F.min("least").alias("least")).select(F.col("least.place").alias("place"))
    kept = docs.withColumn("place", place(docs)).join(least, "place", "left_semi")
    # Equal rows share a place; a second hash of the text keeps others apart.
    return kept.withColumn("other", F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")))).dropDuplicates(["place", "other"]).select(*docs.columns)
