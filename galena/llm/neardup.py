"""MinHash near-duplicates by a chosen-path set similarity join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import discard, materialize, slices, trim
from .graph import components

#: Words of a shingle; sets are linked from this percentage of their union on.
SHINGLE, PERCENT = 4, 80
#: Minwise values of a set.
VALUES = 64
#: Independent trees: a pair at the threshold shares the root's token in 4 of 5 trees, so all miss it once in 390,000.
TREES = 8
#: The first tree is searched alone: what it links need not be compared in the others.
ROUNDS = (range(1), range(1, TREES))
#: Nodes up to this size are compared exhaustively. Larger ones branch, first by FIRST minwise tokens, below by one, one
#: node in four by two, down to LEVELS levels: a pair at the threshold shares a token in 4 of 5 cases, so one that is
#: in a large node has FIRST * 0.8 nodes in common below it on average, on each level.
SMALL, FIRST, LEVELS = 2048, 4, 24
#: Of the minwise values two sets must share as many to be compared in full; a pair at the threshold shares 51 of 64 on
#: average with a standard deviation of 3.2, so it has fewer once in 10 million.
LEAST_SHARED = 34
#: Members of one group that a node larger than SMALL is dealt into, and the sets of the node that join each of its groups.
GROUP, PIVOTS = 512, 4
#: Hashes of full sets that one group compares, about; of more, blocks meet block by block.
MOST_HASHES = 1_000_000
#: Up to as many keys are held in a Bloom filter (1 MB for each million), so that only what may be concerned is shuffled;
#: beyond, all rows are. The results are the same.
FILTER_KEYS = 8_000_000
WORDS_KEPT = 400_000
BLOCK = 2048

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20_240_101)
_MULTIPLY = _RANDOM.integers(1 << 62, size=VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(1 << 63, size=VALUES, dtype=np.uint64)
#: Which minwise values each tree takes, from the root down.
_TAKES = [[int(x) for x in np.random.default_rng(t).permutation([i for i in range(VALUES) if i != t])] for t in range(TREES)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingles as sorted 64-bit hashes, of texts in which A-Z are lower-cased."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _BASE + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the least value of each hash function over a set."""
    least = np.full(VALUES, ~np.uint64(0))
    for i in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[i : i + BLOCK, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sets(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> a row per row: doc_id, n (of shingles), print (128 bits of the set; null if it is
    empty), wide (its minwise values, 4 bytes each) and narrow (a byte of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in slices(batches):
            n, prints, wide, narrow = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle(text)
                n.append(len(s))
                if not len(s):
                    prints.append(None)
                    wide.append(None)
                    narrow.append(None)
                    continue
                m = minwise(s)
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                wide.append(m.tobytes())
                narrow.append((m & 255).astype(np.uint8).tobytes())
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, t) for x, t in zip((n, prints, wide, narrow), kinds, strict=True))], ["doc_id", "n", "print", "wide", "narrow"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print binary, wide binary, narrow binary")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, as tables of many whole runs each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != v[0]
        at = np.flatnonzero(change)
        if not len(at):
            held.append(b)
            continue
        if held or at[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, at[-1])])
        held = [b.slice(at[-1])]
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin, and the end."""
    change = np.ones(table.num_rows + 1, bool)
    change[1:-1] = False
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def resembling(n: np.ndarray, narrow: np.ndarray, label: np.ndarray, asked: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a group's members must be compared in full: a matrix. Their minwise values and sizes allow a link,
    their labels differ, and one of them is asked."""
    m = len(n)
    near, by_value = np.empty((m, m), bool), np.ascontiguousarray(narrow.T)
    for i in range(0, m, 256):
        shared = np.zeros((min(256, m - i), m), np.uint8)
        for v in by_value:
            shared += v[i : i + 256, None] == v[None, :]
        near[i : i + 256] = shared >= LEAST_SHARED
    near &= (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])
    return near & (label[:, None] != label[None, :]) & (asked[:, None] | asked[None, :])


def _value(wide: Column, i: int) -> Column:
    return F.substring(wide, 4 * i + 1, 4)


class Forest:
    """Union-find."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two full sets are linked."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(label: np.ndarray, near: np.ndarray, full: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The links of full sets among the pairs that are near, as pairs of labels: enough of them to connect all labels that
    the links connect. Pairs whose labels are connected already are not compared."""
    names, at = np.unique(label, return_inverse=True)
    begun = at.copy()
    if len(full) == 2:
        return [(int(label[0]), int(label[1]))] if near[0, 1] and linked(*full, percent) else []
    size = np.array([len(s) for s in full])
    codes = np.unique(np.concatenate(full), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mine = np.zeros(int(codes.max(initial=0)) + 1, bool)
    for i in range(len(full) - 1):
        js = np.flatnonzero(near[i, i + 1 :] & (at[i + 1 :] != at[i]) & (size[i + 1 :] > 0)) + i + 1
        if not len(js) or not size[i]:
            continue
        mine[codes[start[i] : start[i] + size[i]]] = True
        ends = np.cumsum(size[js])
        where = np.repeat(start[js] - ends + size[js], size[js]) + np.arange(ends[-1])
        both = np.add.reduceat(mine[codes[where]].astype(np.int64), ends - size[js])
        mine[codes[start[i] : start[i] + size[i]]] = False
        found = np.unique(at[js[100 * both >= percent * (size[i] + size[js] - both)]])
        if len(found):
            at[np.isin(at, found)] = at[i]
    return [(int(names[a]), int(names[b])) for a, b in set(zip(at.tolist(), begun.tolist(), strict=True)) if a != b]


MEMBERS = "group long, rep long, label long, asked boolean, n long, narrow binary"


def _narrow(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("narrow").to_pylist()), np.uint8).reshape(-1, VALUES)


def picked(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """members (group, rep, label, asked) of groups of bounded size -> those that resemble another of their group, by minwise
    values, with n and narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["group"]):
            n, label, asked, narrow = t.column("n").to_numpy(), t.column("label").to_numpy(), t.column("asked").to_numpy(), _narrow(t)
            cuts = bounds(t, ["group"])
            keep = np.zeros(t.num_rows, bool)
            first = cuts[:-1][np.diff(cuts) == 2]  # most groups are pairs, which are compared at once
            a, b = n[first], n[first + 1]
            hit = ((narrow[first] == narrow[first + 1]).sum(axis=1) >= LEAST_SHARED) & (100 * a >= percent * b) & (100 * b >= percent * a)
            hit &= (label[first] != label[first + 1]) & (asked[first] | asked[first + 1])
            keep[first[hit]] = keep[first[hit] + 1] = True
            for i, j in pairwise(cuts.tolist()):
                if j - i > 2:
                    keep[i:j] = resembling(n[i:j], narrow[i:j], label[i:j], asked[i:j], percent).any(axis=0)
            yield from t.filter(pa.array(keep)).to_batches()
            trim()

    rows = members.join(sketches, F.col("rep") == F.col("_rep")).select("group", "rep", "label", "asked", "n", "narrow")
    return rows.repartition("group").sortWithinPartitions("group", "rep").mapInArrow(run, MEMBERS)


def compared(docs: DataFrame, members: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """members (group, rep, label, asked) of groups of bounded size -> links (a, b) of labels, confirmed by full sets.

    Only members that resemble another by their minwise values take part with their full sets. Groups whose sets hold more
    than MOST_HASHES are dealt into blocks, and each two blocks are a group."""
    near = materialize(picked(members, sketches, percent), "near-picked")
    weight = near.groupBy("group").agg(F.sum("n").alias("_w")).where(F.col("_w") > MOST_HASHES)
    weight = weight.select(F.col("group").alias("_g"), F.ceil(2 * F.col("_w") / MOST_HASHES).cast("long").alias("blocks"))
    heavy = near.join(weight, F.col("group") == F.col("_g"), "left").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.xxhash64("group", F.least(i, F.col("block")), F.greatest(i, F.col("block"))))
    near_all = heavy.select(F.explode(F.when(F.col("blocks").isNull(), F.array("group")).otherwise(meets)).alias("group"), "rep", "label", "asked", "n", "narrow")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, data = Shingler(words), None, b""
        for b in slices(batches):
            found = []
            for text in b.column("text").to_pylist():
                if text != last:
                    last, data = text, shingle(text).tobytes()
                found.append(data)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], [*b.schema.names[:-1], "full"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["group"]):
            cuts, out = bounds(t, ["group"]), []
            label, asked, n, narrow = t.column("label").to_numpy(), t.column("asked").to_numpy(), t.column("n").to_numpy(), _narrow(t)
            sets = t.column("full")
            for i, j in pairwise(cuts.tolist()):
                if j - i > 1:
                    near = resembling(n[i:j], narrow[i:j], label[i:j], asked[i:j], percent)
                    out += confirm(label[i:j], near, [np.frombuffer(s, np.uint64) for s in sets.slice(i, j - i).to_pylist()], percent)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})
            trim()

    texts = docs.select("doc_id", "text")
    if (n := near.count()) <= FILTER_KEYS:  # texts of documents without candidates are not shuffled
        texts = texts.where(bloom.contains(F.col("doc_id"), bloom.fill(near.select(F.col("rep").alias("key")), n, 0.02, 1)))
    rows = texts.join(near_all, F.col("doc_id") == F.col("rep")).select("group", "rep", "label", "asked", "n", "narrow", "text")
    rows = rows.mapInArrow(full, MEMBERS + ", full binary").repartition("group").sortWithinPartitions("group")
    out = materialize(rows.mapInArrow(run, "a long, b long").distinct(), "near-links")
    discard(near)
    return out


def blocked(large: DataFrame, asked: Column) -> DataFrame:
    """large (key, rep, label, size) -> members of groups in which all that is asked meets all of its node. Nodes are dealt
    into parts of about GROUP, and so is what is asked in them."""
    by = lambda what, n: F.pmod(F.xxhash64("rep", F.lit(what)), n)
    node = large.withColumn("asked", asked)
    blocks = materialize(node.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"), F.ceil(F.count_if("asked") / GROUP).cast("long").alias("blocks")).withColumnRenamed("key", "_key"), "near-blocks")
    node = node.join(blocks, F.col("key") == F.col("_key")).withColumn("part", by("part", F.col("parts"))).withColumn("block", by("block", F.col("blocks")))
    zero = F.lit(0).cast("long")
    hers = node.where("asked").select("key", "rep", "label", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), "block", "asked")
    others = node.where("blocks > 0").select("key", "rep", "label", "part", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asked"))
    return hers.union(others).groupBy(F.xxhash64("key", "part", "block").alias("group"), "rep", "label").agg(F.max("asked").alias("asked"))


def searched(docs: DataFrame, classes: DataFrame, labels: DataFrame | None, trees: range, words: int, percent: int) -> list[DataFrame]:
    """classes (rep, n, wide, narrow), labels (id, component: what is linked already, or None) -> tables of confirmed links
    (a, b) of labels that these trees find.

    At the root of each tree a set is in the node of its minwise token. Small nodes are compared. A larger one is first dealt
    into groups that share PIVOTS of its sets, which links most of what is alike. If then most of it has one label, the
    others are compared with all of it; if not, its sets branch by further minwise tokens until nodes are small, and
    after LEVELS levels the sets of a large node meet block by block. Nodes with one label are done.
    """
    sketches, wide = classes.select(F.col("rep").alias("_rep"), "n", "narrow"), classes.select(F.col("rep").alias("_rep"), "wide")

    def relabelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
        """rows (rep, tree, key) with label."""
        if known is None:
            return rows.select("rep", "tree", "key", F.col("rep").alias("label"))
        return rows.join(known.select(F.col("id").alias("_id"), F.col("component").alias("_label")), F.col("rep") == F.col("_id"), "left").select("rep", "tree", "key", F.coalesce("_label", "rep").alias("label"))

    rows = classes.select("rep", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), _value(F.col("wide"), t)).alias("key")) for t in trees])).alias("x")).select("rep", "x.tree", "x.key")
    rows = relabelled(rows, labels)
    found: list[DataFrame] = []
    waiting: list[DataFrame] = []
    held: list[DataFrame] = []
    level, dealt = 0, False
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
        sizes = materialize(sizes.select(F.col("key").alias("_key"), "size"), "near-sizes")  # joined from a table, so that Spark can split what is skewed
        nodes = materialize(rows.join(sizes, F.col("key") == F.col("_key")).select("rep", "tree", "key", "label", "size"), "near-nodes")
        held += [sizes, nodes]
        whole = F.lit(True).alias("asked")
        waiting.append(nodes.where(F.col("size") <= SMALL).select(F.col("key").alias("group"), "rep", "label", whole))
        large = nodes.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        most = large.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"))
        most = materialize(most.select(F.col("key").alias("_key"), F.col("m.c").alias("_most"), F.col("m.label").alias("_main")), "near-most")
        held.append(most)
        large = large.join(most, F.col("key") == F.col("_key")).drop("_key")
        one = 2 * F.col("_most") >= F.col("size")
        last = level == LEVELS
        ended = large.where(F.lit(True) if last else one)
        waiting.append(blocked(ended, ~one | (F.col("label") != F.col("_main"))))
        large = large.where(F.lit(False) if last else ~one)
        if large.isEmpty():
            break
        if not dealt:  # deal into groups that share pivots, link, and look again at what is left
            dealt = True
            part = F.pmod(F.xxhash64("rep", F.lit("part")), F.col("parts"))
            large = large.withColumn("parts", F.ceil(F.col("size") / GROUP).cast("long"))
            pivots = large.groupBy("key", "parts").agg(F.array_distinct(F.array(*[F.min_by(F.struct("rep", "label"), F.xxhash64("rep", F.lit(i))) for i in range(PIVOTS)])).alias("p"))
            pivots = pivots.select("key", F.explode("p").alias("p"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1).alias("part")).select("key", "p.rep", "p.label", F.explode("part").alias("part"))
            members = large.select("key", "rep", "label", part.alias("part")).union(pivots).select(F.xxhash64("key", "part", F.lit("part")).alias("group"), "rep", "label").distinct()
            waiting.append(members.withColumn("asked", whole))
            links = compared(docs, reduce(DataFrame.unionByName, waiting), sketches, words, percent)
            found.append(links)
            waiting = []
            known = components(links if labels is None else links.union(labels.select("id", "component")), "near-known")
            held.append(known)
            rows = relabelled(large.select("rep", "tree", "key"), known)
            continue
        level += 1
        large = large.join(wide, F.col("rep") == F.col("_rep"))
        taken = range(FIRST) if level == 1 else range(FIRST + 2 * level - 4, FIRST + 2 * level - 2)
        keys = []
        for k in taken:  # each tree takes values of its own, in an order of its own
            value = F.lit(None).cast("binary")
            for t in trees:
                value = F.when(F.col("tree") == t, _value(F.col("wide"), _TAKES[t][k])).otherwise(value)
            keys.append(F.xxhash64("key", F.lit(k), value))
        below = F.array(*keys)
        if level > 1:
            below = F.when(F.pmod(F.xxhash64("key", F.lit("branch")), F.lit(4)) == 0, below).otherwise(F.array(keys[0]))
        rows = large.select("rep", "tree", F.explode(below).alias("key"), "label")
        rows = materialize(rows, "near-rows")
        held.append(rows)
    found.append(compared(docs, reduce(DataFrame.unionByName, waiting), sketches, words, percent))
    discard(*held)
    return found


def links(docs: DataFrame, classes: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between classes, which connect all that is linked."""
    found: list[DataFrame] = []
    labels: DataFrame | None = None
    for i, trees in enumerate(ROUNDS):
        found += searched(docs, classes, labels, trees, words, percent)
        if i < len(ROUNDS) - 1:
            labels = components(reduce(DataFrame.unionByName, found), "near-labels")
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> a row per row: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of shingles share at least percent of their union; component_id is the smallest
    doc_id that is reached by links. A text with fewer words than a shingle is one shingle; a null or empty text has
    none and is linked with nothing. Rows with one doc_id are one document, whose texts all count. A null doc_id joins
    the component of its set, which is null if no other row has that set; it is then kept. Equal sets are
    one class from the start, so groups of copies cost no comparison. An empty table gives an empty one.
    """
    base = materialize(sets(docs, words), "near-sets")
    classes = base.where("print IS NOT NULL").groupBy("print", "n", "wide", "narrow").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "near-classes")
    again = base.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("_p"), F.max("print").alias("_q")).where("_p < _q").select("doc_id")
    same = base.join(again, "doc_id", "left_semi").join(classes.select("print", "rep"), "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = links(docs, classes.where("rep IS NOT NULL"), words, percent).union(same)
    label = components(found, "near-links").select(F.col("id").alias("_id"), "component")
    known = classes.join(label, F.col("rep") == F.col("_id"), "left").select(F.col("print").alias("_print"), F.coalesce("component", "rep").alias("component_id"))
    known = materialize(known, "near-classes")  # joined from a table, so that Spark can split a print with many rows
    full = base.where("print IS NOT NULL").join(known, F.col("print") == F.col("_print")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = base.where("print IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    discard(classes)
    return full.union(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each group of near duplicates, with all its columns, whatever their names.

    Rows without doc_id stay, and of rows with one doc_id one. A null or empty text is like no other, so its row stays.
    An empty table gives an empty one.
    """
    name = "_gone"
    while name in docs.columns:
        name = "_" + name
    gone = near_duplicates(docs, words, percent).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    gone = materialize(gone, "near-gone")
    out = docs
    if (n := gone.count()) <= FILTER_KEYS:  # only documents that may go are shuffled to find out
        maybe = bloom.contains(F.col("doc_id"), bloom.fill(gone.select(F.col(name).alias("key")), n, 0.02, 2))
        sure, out = docs.where(~maybe), docs.where(maybe)
    out = out.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    if n <= FILTER_KEYS:
        out = sure.unionByName(out)
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))
    return out


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
