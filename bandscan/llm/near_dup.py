"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct `words`-word shingles (all its words as
one, if it has fewer), as 64-bit hashes. Documents with equal sets form a
class (128-bit digest of the set); one representative of each goes on, so
copies are never compared with each other.

Trees of paths find candidates. At the root of each tree, each document
branches on one of its 64 minwise tokens; documents that share it share a
node. A node of up to `bound` members is a leaf: one task compares its members
exhaustively by their tokens. Members of larger nodes are first dealt to leaves
at random, each in its smallest ones, `DEALS` times a level whatever the number
of its nodes. A node that this connects is done (more comparisons could not
change any component); so is one in which up to half a leaf's members are
outside the largest component: these meet slices of that component, and one
another, in leaves. Else its members branch on: each follows one further
token, and with a probability of 1/3 a second one, so that a pair of similarity
0.75 has one common path a level to go on. Members of three or more large root
nodes get further independent trees. Nodes that are still large at `depth` are
compared exhaustively, in slices.

In a leaf, members that agree in 28 of 64 tokens are candidates. Where they are
few, all of them go on. In a dense group only a spanning forest does, of the
pairs that agree most; if the links among these do not connect the group, all
its members are compared exhaustively on their full sets, in slices that fit a
task, and a forest of the true links comes back. So no work grows with the
square of a group of copies.

Every link is confirmed on the full sets: 100 * common >= percent * united.
Only documents with candidates have their sets made and written; links, nodes
and components stay in tables in the shared folder.

`missed` computes the chance that a pair of similarity 0.75 meets in no leaf or
agrees in fewer than 28 tokens: 9e-8 where root nodes are leaves (1e-6 if two
are not), 5e-5 below ten branchings; any link to its component will do, also
one found in a random leaf. tests/llm measures recall
against brute force on families whose members are just below the threshold.

Defined results: null and empty texts and those without words have an empty
set and are linked with nothing; a null id takes no part, its component is
null and it is kept; repeated rows fall into one component and each keep their
row; rows of equal id with different texts are one document of several texts:
links of any of them count for the id; an empty table gives an empty result;
texts may be of any length, one that exceeds a block of work is one of its own;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.llm.common import by_batch, removed, shared_dir, stored
from bandscan.llm.components import components
from bandscan.llm.numtext import FOLDED, blocks, mix, separators, words

#: Trees of all documents, further trees of members of nodes that branch, minwise tokens, levels.
TREES, MORE_TREES, TOKENS, DEPTH = 12, 24, 64, 24
#: Large root nodes from which on a document gets further trees; times that a member is dealt at random to leaves of one large node, and of all together.
OFTEN, TURNS, DEALS = 3, 2, 6
#: Tokens in which a candidate agrees at least, and members of a leaf.
AGREED, BOUND = 28, 2000
#: Members of nodes whose pairs are listed without a matrix, and candidates a member in a group that is not dense.
FEW, SPARSE = 8, 4
#: Shingles and members of a slice, two of which meet in a task; shingles of so many members go through a matrix product.
SLICE_SHINGLES, SLICE_MEMBERS, COMMON = 1_000_000, 2000, 32
#: Ids that may be broadcast to the scan that makes their sets; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
_APART = separators("space")
_TIMES = mix(np.arange(1001, 1001 + TOKENS, dtype=np.uint64)) | np.uint64(1)


def missed(levels: int, similarity: float = 0.75) -> float:
    """The chance that a pair meets in no leaf, if leaves are so many branchings below the roots, or agrees too little."""
    lost = 0.0
    for _ in range(levels):
        on = similarity * (1 - lost)
        lost = (1 - on) * (1 - on / 3)
    trees = TREES + (MORE_TREES if levels else 0)
    few = sum(comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k) for k in range(AGREED))
    return (1 - similarity * (1 - lost)) ** trees + few


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for _, _, raw, at in blocks(texts):
        h, word_at = words(raw, at, _APART, FOLDED)
        run = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            run += h[k : k + len(run)] * odd[k]
        run = mix(run)
        for lo, hi in zip(word_at, word_at[1:]):
            if hi - lo >= size:
                yield np.unique(run[lo : hi - size + 1])
            elif hi > lo:
                yield mix(np.array([(h[lo:hi] * odd[: hi - lo]).sum(dtype=np.uint64) ^ np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    return tuple(int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, d1, d2, sig, short) of documents (id, text): set size, set digest, minwise tokens, a byte of each."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, d1, d2, sig = [], [], [], []
        for s in shingle_sets(b.column(1), size):
            n.append(len(s))
            x, y = _digest(s)
            d1.append(x)
            d2.append(y)
            if len(s) > 4096:
                low = np.array([(s * t).min() for t in _TIMES])
            else:
                low = (s[None, :] * _TIMES[:, None]).min(1) if len(s) else np.zeros(len(_TIMES), np.uint64)
            sig.append(mix(low).astype(np.uint32).view(np.int32))
        sig = np.concatenate(sig)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TOKENS, pa.int32()), pa.array(sig))
        short = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TOKENS), len(n), [None, pa.py_buffer(sig.view(np.uint8)[::4].tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists, short], names=["id", "n", "d1", "d2", "sig", "short"])

    return docs.select("id", "text").mapInArrow(by_batch(run), f"id {docs.schema['id'].dataType.simpleString()}, n long, d1 long, d2 long, sig array<int>, short binary")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, set) of the documents in wanted (id, d1), the sets as bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = list(shingle_sets(b.column(1), size))
        keep = pa.array([_digest(s)[0] == d for s, d in zip(sets, b.column(2).to_pylist())], pa.bool_())
        out = pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])
        return out.filter(keep)

    return docs.join(wanted, "id").select("id", "text", "d1").mapInArrow(by_batch(run), f"id {kind}, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    b's sets travel with the pairs to a's, of which a task then holds one copy a row.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            common = 0
            if 100 * len(small) >= percent * len(large):
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    full = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    return full.select("a", "b", "sa", "sb").mapInArrow(by_batch(run), f"a {kind}, b {kind}")


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, k) among all pairs of sets, as many as connect what similar pairs connect."""
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(m), n), np.zeros((m, m), np.int32)
    column = np.where(count >= COMMON, np.cumsum(count >= COMMON) - 1, -1)[at]
    columns = int(column.max(initial=-1)) + 1
    for lo in range(0, columns, 4096):
        here = (column >= lo) & (column < lo + 4096)
        held = np.zeros((m, min(4096, columns - lo)), np.float32)
        held[row[here], column[here] - lo] = 1
        common += (held @ held.T).astype(np.int32)
    order = np.argsort(at, kind="stable")
    by_shingle, times = row[order], count[at[order]]
    for c in range(2, COMMON):
        r = by_shingle[times == c].reshape(-1, c)
        for k in range(1, c):
            for x, y in ((r[:, k:], r[:, :-k]), (r[:, :-k], r[:, k:])):
                np.add.at(common, (x.ravel(), y.ravel()), 1)
    similar = 100 * common.astype(np.int64) >= percent * (n[:, None] + n[None, :] - common)
    out, fresh = [], np.ones(m, bool)
    for start in range(m):
        todo = [start] if fresh[start] else []
        fresh[start] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(similar[i] & fresh).tolist()
            fresh[new] = False
            out += [(i, k) for k in new]
            todo += new
    return out


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label, with those that edges (x, y) connect made equal."""
    while True:
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            return label
        low = np.arange(len(label))
        np.minimum.at(low, lx, ly)
        np.minimum.at(low, ly, lx)
        label = low[label]


def leaf(short: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (i, k) among members, and the dense group of each member, or -1.

    short holds their tokens' bytes, comp their component so far; pairs within
    a component are no candidates.
    """
    m = len(comp)
    same = np.zeros((m, m), np.uint8)
    for k in range(TOKENS):
        t = short[:, k]
        same += t[:, None] == t[None, :]
    same[(same < AGREED) | (comp[:, None] == comp[None, :])] = 0
    none = np.full(m, -1)
    if not same.any():
        return none[:0], none[:0], none
    _, label = np.unique(comp, return_inverse=True)
    x, y, left = [], [], same.copy()
    while True:
        # each label's best pair with another one (ties: any, but the same for all)
        best = left.argmax(1)
        how = left[np.arange(m), best]
        order = np.lexsort((np.arange(m), -how.astype(np.int64), label))
        first = order[np.concatenate([[True], label[order][1:] != label[order][:-1]])]
        first = first[how[first] > 0]
        if not len(first):
            break
        x.append(first)
        y.append(best[first])
        label = _joined(label, first, best[first])
        left[label[:, None] == label[None, :]] = 0
    x, y = np.concatenate(x), np.concatenate(y)
    with_some = same.any(1)
    pairs = np.bincount(label, (same > 0).sum(1), minlength=label.max() + 1) / 2
    members = np.bincount(label, with_some, minlength=len(pairs))
    dense = pairs > SPARSE * members
    i, k = np.nonzero(np.triu(same) * ~dense[label][:, None])
    keep = dense[label[x]]
    x, y = np.concatenate([x[keep], i]), np.concatenate([y[keep], k])
    return x, y, np.where(dense[label] & with_some, label, -1)


def _leaves(members: DataFrame, kind: str, dense: bool = True) -> DataFrame:
    """(a, b, ids, ns) of leaves' members (path, id, comp, short, n): candidates (a, b), and the members and set sizes of each dense group.

    dense: without it, only the candidates.
    """

    def edges(b: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Candidates by row, and the rows of each dense group, of whole nodes in order of path."""
        path = b.column("path").to_numpy()
        at = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
        size = np.diff(at)
        raw = b.column("short").combine_chunks()
        short = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, TOKENS)
        comp = pc.dictionary_encode(b.column("comp").combine_chunks()).indices.to_numpy()
        node = np.repeat(np.arange(len(size)), size)
        few = (size <= FEW)[node]
        xs, ys, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for k in range(1, FEW):
            i = np.flatnonzero(few[:-k] & (node[k:] == node[:-k]) & (comp[k:] != comp[:-k]))
            i = i[(short[i] == short[i + k]).sum(1) >= AGREED]
            xs.append(i)
            ys.append(i + k)
        for n in np.flatnonzero(size > FEW):
            here = slice(at[n], at[n + 1])
            x, y, group = leaf(short[here], comp[here])
            xs.append(x + at[n])
            ys.append(y + at[n])
            groups += [np.flatnonzero(group == g) + at[n] for g in np.unique(group[group >= 0])] if dense else []
        return np.concatenate(xs), np.concatenate(ys), groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is None:
                whole, held = held, None
            else:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                path = held.column("path").to_numpy()
                cut = int(np.searchsorted(path, path[-1])) if len(path) else 0
                if not cut:
                    continue
                whole, held = held.slice(0, cut), held.slice(cut)
            if whole is None or not whole.num_rows:
                continue
            x, y, groups = edges(whole)
            ids = whole.column("id").combine_chunks()
            none, names = pa.nulls, ["a", "b", "ids", "ns"]
            if len(x):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), none(len(x), pa.list_(ids.type)), none(len(x), pa.list_(pa.int64()))], names=names)
            if groups:
                ends, rows = pa.array(np.cumsum([0, *map(len, groups)]), pa.int32()), pa.array(np.concatenate(groups))
                lists = [pa.ListArray.from_arrays(ends, v.take(rows)) for v in (ids, whole.column("n").combine_chunks())]
                yield pa.RecordBatch.from_arrays([none(len(groups), ids.type), none(len(groups), ids.type), *lists], names=names)

    dealt = members.repartition("path").sortWithinPartitions("path")
    return dealt.select("path", "id", "comp", "short", "n").mapInArrow(run, f"a {kind}, b {kind}, ids array<{kind}>, ns array<bigint>")


def _lists(rows: DataFrame) -> DataFrame:
    """rows as one list an id (id, own), so that a join on id makes one row an id."""
    return rows.groupBy("id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "id"))).alias("own"))


def _rows(lists: DataFrame) -> DataFrame:
    """The rows of lists, each with its id's other columns."""
    return lists.select(*(c for c in lists.columns if c != "own"), F.inline("own"))


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


class _Links:
    """Components of the confirmed links so far, and the sets made for them."""

    def __init__(self, docs: DataFrame, reps: DataFrame, folder: str, size: int, percent: int):
        self.docs, self.reps, self.folder, self.size, self.percent = docs, reps, folder, size, percent
        self.comps = self.sets = None
        self.n = 0

    def add(self, pairs: DataFrame) -> None:
        """Confirms candidates (a, b) and brings the components up to date."""
        self.n += 1
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), self.folder, f"pairs-{self.n}")
        if self._need(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()):
            self._found(_confirmed(pairs, self.sets, self.percent))
        removed(self.docs.sparkSession, f"{self.folder}/pairs-{self.n}")

    def within(self, groups: DataFrame) -> None:
        """Links among all members of each of the groups (grp, id, n) whose members are not all connected, on full sets."""
        self.n += 1
        spark, percent, kind = self.docs.sparkSession, self.percent, groups.schema["id"].dataType.simpleString()
        still = _rows(self.labelled(_lists(groups))).groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        # a group beyond a slice's bounds is dealt to slices, and each two of these meet in a task
        slices = F.expr(f"cast(if(shingles <= {SLICE_SHINGLES} AND m <= {SLICE_MEMBERS}, 1, greatest(2, ceil(2 * shingles / {SLICE_SHINGLES}), ceil(2 * m / {SLICE_MEMBERS}))) AS int)")
        still = stored(still.select("grp", slices.alias("k")), self.folder, f"still-{self.n}")
        if still.isEmpty():
            return
        mine = "cast(pmod(xxhash64(id, grp), k) AS int)"
        met = F.explode(F.expr(f"if(k = 1, array(0), transform(filter(sequence(0, k - 1), j -> j != {mine}), j -> least(j, {mine}) * k + greatest(j, {mine})))"))
        dealt = stored(groups.join(still, "grp").select("grp", met.alias("cell"), "id"), self.folder, f"dealt-{self.n}")
        self._need(dealt.select("id").distinct())

        def run(t: pa.Table) -> pa.Table:
            ids = t.column("id").combine_chunks()
            links = forest([np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("set")], percent)
            a, b = (ids.take(pa.array([x[k] for x in links], pa.int64())) for k in (0, 1))
            return pa.table({"a": a, "b": b})

        found = _rows(_lists(dealt).join(self.sets, "id")).groupBy("grp", "cell").applyInArrow(run, f"a {kind}, b {kind}")
        self._found(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        removed(spark, f"{self.folder}/still-{self.n}", f"{self.folder}/dealt-{self.n}")

    def _need(self, ids: DataFrame) -> bool:
        """Makes the sets of these ids that are not there yet; whether there are sets at all."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("id"), "id", "left_anti")
        ids = stored(ids.join(self.reps.select("id", "d1"), "id"), self.folder, f"ids-{self.n}")
        if count := ids.count():
            new = stored(_sets(self.docs, F.broadcast(ids) if count <= BROADCAST_IDS else ids, self.size), self.folder, f"sets-{self.n}")
            self.sets = new if self.sets is None else self.sets.unionAll(new)
        removed(self.docs.sparkSession, f"{self.folder}/ids-{self.n}")
        return self.sets is not None

    def _found(self, links: DataFrame) -> None:
        """Brings the components up to date: new links are taken between components so far."""
        found, folder = stored(links, self.folder, f"links-{self.n}"), f"{self.folder}/comps-{self.n}"
        if self.comps is not None:
            ends = [self.comps.select(F.col("id").alias(x), F.col("comp").alias(f"of_{x}")) for x in ("a", "b")]
            found = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
            found = stored(found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), self.folder, f"across-{self.n}")
        if not found.isEmpty():
            new, old = components(found, folder), self.comps
            if old is not None:
                up = new.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
                moved = old.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
                new = stored(moved.unionAll(new.join(old.select("id"), "id", "left_anti").select("id", "comp")), folder, "all")
            self.comps = new
        removed(self.docs.sparkSession, f"{self.folder}/links-{self.n}", f"{self.folder}/across-{self.n}")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Adds each id's component so far; rows: one an id."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(self.comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _roots(reps: DataFrame, first: int, trees: int) -> DataFrame:
    """(path, id): the root nodes of so many trees."""
    return reps.select(F.explode(F.expr(f"transform(sequence({first}, {first + trees - 1}), c -> xxhash64(c, sig[c % {TOKENS}]))")).alias("path"), "id")


def _branched(rows: DataFrame) -> DataFrame:
    """rows (path, id, sig) with the paths of the next level: one token of the path's choice, for a third of the paths a second."""
    token = lambda salt: f"sig[cast(pmod(xxhash64(path, {salt}), {TOKENS}) AS int)]"
    first, second = (f"xxhash64(path, {k}, {token(k)})" for k in (1, 2))
    paths = F.expr(f"if(pmod(xxhash64(path, 3), 3) = 0, array({first}, {second}), array({first}))")
    return rows.select(F.explode(paths).alias("path"), "id")


def _dealt(held: DataFrame, bound: int) -> DataFrame:
    """(path, id, comp, short, n): random leaves of large nodes, for documents held (id, own of (path, m), comp, short, n).

    DEALS rows a document at most: one for each node would grow with the levels and trees that a large group takes.
    Smaller nodes come first, as a group is less spread in them, and all of its members choose much the same ones.
    """
    nodes = "array_sort(transform(own, x -> struct(x.m, x.path)))"
    parts = ", ".join(f"transform({nodes}, x -> xxhash64(x.path, {turn}, pmod(xxhash64(id, x.path, {turn}), ceil(2 * x.m / {bound}))))" for turn in range(TURNS))
    return held.selectExpr(f"explode(slice(concat({parts}), 1, {DEALS})) AS path", "id", "comp", "short", "n")


def _closing(labelled: DataFrame, bound: int) -> DataFrame:
    """(path, top, slices, rest) of nodes of few members outside their largest component: that one, its slices, and the others' number."""
    of_comp = labelled.groupBy("path", "comp").agg(F.count("*").alias("c"))
    by_node = of_comp.groupBy("path").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("t"))
    return by_node.where(f"2 * (m - t.c) <= {bound}").selectExpr("path", "t.comp AS top", f"ceil(2 * t.c / {bound}) AS slices", "m - t.c AS rest")


def _closed(labelled: DataFrame, closing: DataFrame) -> DataFrame:
    """(path, id): leaves in which all members outside a closing node's largest component meet all members."""
    cells = "if(comp = top, array(pmod(xxhash64(id, path), slices)), sequence(0, slices - 1))"
    return labelled.join(closing.where("rest > 0"), "path").selectExpr("path", "id", f"explode({cells}) AS cell").selectExpr("xxhash64(path, 4, cell) AS path", "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bound: int = BOUND, depth: int = DEPTH) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each document."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sigs = stored(signatures(docs, size), folder, "sigs")
    in_class = sigs.where("id IS NOT NULL AND n > 0")
    reps = stored(in_class.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("short").alias("short"), F.first("n").alias("n")), folder, "reps")
    links, known = _Links(docs, reps, folder, size, percent), reps.select("id", "short", "n")
    rows, level, small, groups = _roots(reps, 0, TREES), 0, [], []
    while True:
        nodes = stored(rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), folder, f"nodes-{level}")
        large = nodes.where(F.col("m") > bound)
        # most root nodes are single documents, which never reach a leaf; below, few are, and only large nodes are left out
        small.append(rows.join(nodes.where(F.col("m") <= bound).select("path"), "path") if level == 0 else rows.join(large.select("path"), "path", "left_anti"))
        if large.isEmpty():
            break
        # tokens are joined once a level and a document
        held = stored(_lists(rows.join(large, "path").select("path", "id", "m")).join(reps.select("id", "sig", "short", "n"), "id"), folder, f"large-{level}")
        links.add(_leaves(_dealt(links.labelled(held.drop("sig")), bound), kind, dense=False).select("a", "b"))
        labelled = stored(_rows(links.labelled(held.drop("short"))).select("path", "id", "sig", "n", "comp"), folder, f"labelled-{level}")
        closing = stored(_closing(labelled, bound), folder, f"closing-{level}")
        small.append(stored(_closed(labelled, closing), folder, f"closed-{level}"))
        rows = stored(labelled.join(closing.select("path"), "path", "left_anti").select("path", "id", "sig", "n"), folder, f"open-{level}")
        removed(spark, f"{folder}/large-{level}", f"{folder}/labelled-{level}")
        if level == depth:
            groups.append(rows.select(F.col("path").alias("grp"), "id", "n"))
            break
        more = _branched(rows)
        if level == 0:
            often = rows.groupBy("id").agg(F.count("*").alias("c")).where(f"c >= {OFTEN}").select("id")
            more = more.unionAll(_roots(reps.join(often, "id", "left_semi"), TREES, MORE_TREES))
        rows, level = stored(more.distinct(), folder, f"rows-{level + 1}"), level + 1
    members = small[0]
    for one in small[1:]:
        members = members.unionAll(one)
    found = stored(_leaves(_rows(links.labelled(_lists(members.select("path", "id")).join(known, "id"))), kind), folder, "leaves")
    links.add(found.where("b IS NOT NULL").select("a", "b"))
    dense = found.where("ids IS NOT NULL").select(F.xxhash64("ids").alias("grp"), F.explode(F.arrays_zip("ids", "ns")).alias("m"))
    groups.append(dense.select("grp", F.col("m.ids").alias("id"), F.col("m.ns").alias("n")))
    for one in groups:
        links.within(one)
    comps = links.comps
    tops = reps.select("d1", "d2", "id")
    if comps is not None:
        tops = tops.join(comps, "id", "left").select("d1", "d2", F.coalesce("comp", "id").alias("component_id"))
    else:
        tops = tops.select("d1", "d2", F.col("id").alias("component_id"))
    tops = stored(tops, folder, "tops")
    removed(spark, f"{folder}/reps", f"{folder}/leaves", *(f"{folder}/{what}-{k}" for k in range(level + 1) for what in ("nodes", "closing", "closed", "open", "rows")), *(f"{folder}/{what}-{k}" for k in range(1, links.n + 1) for what in ("sets", "comps")))
    out = sigs.select("id", "n", "d1", "d2").join(tops, ["d1", "d2"], "left")
    comp = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, that are kept: of each component the one of smallest id, and those without an id.

    Rows of a kept id are kept, also where they repeat.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("__kept")).where("__kept IS NOT NULL").distinct()
    return docs.where(F.col(id_col).isNull()).unionAll(docs.join(kept, F.col(id_col) == F.col("__kept"), "left_semi"))
