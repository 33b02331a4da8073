"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(scale * x). Equal vectors are gathered first,
with the k + 1 smallest of their ids, which is all that any result can need.
Distinct candidates and distinct query vectors are dealt into blocks of
bounded size around pivots (a bounded sample; it only shapes the blocks).

Each block gets a cover tree, built once and stored with it: a node's children
are centred on its own points, more than its radius over 1.3 apart, and cover
all its points within that; radii shrink level by level down to single points
or buckets of up to 8. No node has a cap on its children.

Blocks of candidates are sent only to those groups of query blocks where
centres and covering radii allow a product that reaches the group's worst k-th
score so far (every query starts from its k-th score among the pivots). There,
query tree and candidate tree are searched together: a pair of nodes is given
up if its largest possible product stays below the worst k-th score in the
query node; equal scores are kept, because ids break ties. A candidate node's
children are tried against the queries left, by the children's own radii.
Products are exact in float32 or float64 while norms say so, else in integers.

A task holds one group of query blocks and streams candidate blocks past it.
Results are cut to k + 1 per query vector and merged by query vector; at last
each query's own id is taken out.

Defined results: a vector that is null, or holds a null, NaN or infinite
component, or has a null id, takes no part; shorter vectors count as followed
by zeros; rows with equal id and vector count once; rows of equal id with
different vectors are candidates of their own, and a query of that id gets the
best of all its vectors' lists; a query that has fewer candidates gets them
all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.llm.common import by_batch, removed, shared_dir, stored

SCALE, BUCKET, SHRINK = 64, 8, 1.3
#: Vectors of a block, query blocks that a task holds, and pivots.
CANDIDATE_BLOCK, QUERY_BLOCK, QUERY_BLOCKS, PIVOTS = 8192, 1024, 16, 256
#: Bytes of query groups' centres that travel with the scan that bounds blocks; beyond, no block is given up before it is sent.
CENTRE_BYTES = 32 << 20


def _padded(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for k, r in enumerate(rows):
        v = np.frombuffer(r, "<i8")
        out[k, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; a float holds every partial sum while the product of norms is below its integers."""
    top = float(np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(1).max(initial=0)))
    if top < 2**23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if top < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _cover(points: np.ndarray, reach: float) -> np.ndarray:
    """The place of each point's centre among points; centres are more than the reach apart."""
    of, left, square = np.full(len(points), -1), np.arange(len(points)), (points**2).sum(1)
    while len(left):
        tried = left[:256]
        gap = square[tried][:, None] + square[tried][None, :] - 2 * points[tried] @ points[tried].T
        centres: list[int] = []
        for k in range(len(tried)):
            if not centres or gap[k, centres].min() > reach * reach:
                centres.append(k)
        centres = tried[centres]
        gap = square[left][:, None] + square[centres][None, :] - 2 * points[left] @ points[centres].T
        near = gap.argmin(1)
        inside = (gap[np.arange(len(left)), near] <= reach * reach) | np.isin(left, centres)
        of[left[inside]] = centres[near[inside]]
        of[centres] = centres
        left = left[~inside]
    return of


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, nodes): nodes as rows (centre, radius, first point, end, first child, children) by level, over points in that order."""
    points = points.astype(float)
    order = np.arange(len(points))
    middle = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    todo, nodes = [(0, len(points), middle)], []
    while todo:
        later = []
        for lo, hi, centre in todo:
            here = order[lo:hi]
            radius = float(np.sqrt(((points[here] - points[centre]) ** 2).sum(1).max()))
            node = [centre, radius * (1 + 1e-12), lo, hi, -1, 0]
            if hi - lo > BUCKET and radius > 0:
                own = np.concatenate([[np.flatnonzero(here == centre)[0]], np.flatnonzero(here != centre)])
                here = here[own]
                of = _cover(points[here], radius / SHRINK)
                by = np.argsort(of, kind="stable")
                order[lo:hi], of = here[by], of[by]
                cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                for x, z in zip(cut, [*cut[1:], hi - lo]):
                    later.append((lo + int(x), lo + int(z), int(here[of[x]])))
                node[5] = len(cut)
            nodes.append(node)
        # the children of a level's nodes follow each other
        first = len(nodes)
        for node in nodes[len(nodes) - len(todo) :]:
            if node[5]:
                node[4], first = first, first + node[5]
        todo = later
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.array(nodes, float)
    table[:, 0] = place[table[:, 0].astype(np.int64)]
    return order, table


class Tree:
    """A block's vectors in order of its cover tree."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray):
        self.points, self.exact = points.astype(float), points
        self.radius = nodes[:, 1]
        self.centre, self.lo, self.hi, self.first, self.children = (nodes[:, k].astype(np.int64) for k in (0, 2, 3, 4, 5))
        self.norm = np.sqrt((self.points**2).sum(1))


class Search:
    """The best k + 1 candidates of each query of a block, over the blocks of candidates that come past."""

    def __init__(self, queries: Tree, floor: np.ndarray, k: int):
        self.q, self.k, self.worst = queries, k, floor.astype(np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in floor]
        self.tried = self.pruned = 0

    def run(self, candidates: Tree, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tries a block; least: each candidate's smallest id. Returns (scores, places) new to each query."""
        self.c, self.least = candidates, least
        self.fresh = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.worst]
        self.visit(0, 0)
        return self.fresh

    def visit(self, a: int, b: int) -> None:
        """A query node against a candidate node."""
        q, c = self.q, self.c
        most = q.points[q.centre[a]] @ c.points[c.centre[b]] + q.norm[q.centre[a]] * c.radius[b] + c.norm[c.centre[b]] * q.radius[a] + q.radius[a] * c.radius[b]
        self.tried += 1
        if most + 1e-6 * abs(most) + 1e-6 < self.worst[q.lo[a] : q.hi[a]].min():
            self.pruned += 1
            return
        if q.children[a] and q.radius[a] >= c.radius[b]:
            kids = np.arange(q.first[a], q.first[a] + q.children[a])
            large = q.hi[kids] - q.lo[kids] > BUCKET
            for kid in kids[large]:
                self.visit(int(kid), b)
            rest = np.concatenate([np.zeros(0, np.int64), *(np.arange(q.lo[x], q.hi[x]) for x in kids[~large])])
        else:
            rest = np.arange(q.lo[a], q.hi[a])
        if len(rest):
            self.expand(rest, b)

    def expand(self, queries: np.ndarray, b: int) -> None:
        """Single queries against the children of a candidate node."""
        c = self.c
        if not c.children[b]:
            self.leaf(queries, np.arange(c.lo[b], c.hi[b]))
            return
        kids = np.arange(c.first[b], c.first[b] + c.children[b])
        small = c.hi[kids] - c.lo[kids] <= BUCKET
        single = c.hi[kids] - c.lo[kids] == 1
        most = self.q.points[queries] @ c.points[c.centre[kids]].T + self.q.norm[queries][:, None] * c.radius[kids][None, :]
        most += 1e-6 * np.abs(most) + 1e-6
        on = most >= self.worst[queries][:, None]
        self.tried += on.size
        self.pruned += int(on.size - on.sum())
        some = small & on.any(0)
        if some.any():
            points = np.concatenate([c.lo[kids[some & single]], *(np.arange(c.lo[x], c.hi[x]) for x in kids[some & ~single])])
            use = on[:, some].any(1)
            self.leaf(queries[use], points)
        for i in np.argsort(-most.max(0), kind="stable"):
            if not small[i]:
                left = queries[most[:, i] >= self.worst[queries]]
                if len(left):
                    self.expand(left, int(kids[i]))

    def leaf(self, qi: np.ndarray, ci: np.ndarray) -> None:
        scores = products(self.q.exact[qi], self.c.exact[ci])
        some = scores >= self.worst[qi][:, None]
        for k in np.flatnonzero(some.any(1)):
            q, row = qi[k], scores[k]
            at = np.flatnonzero(some[k])
            if len(at) > 4 * self.k:  # all that reach the k-th score here
                cut = np.partition(row[at], len(at) - self.k)[len(at) - self.k]
                at = at[row[at] >= cut]
            new = np.concatenate([self.fresh[q][0], row[at]]), np.concatenate([self.fresh[q][1], ci[at]])
            keep = np.lexsort((self.least[new[1]], -new[0]))[: self.k]
            self.fresh[q] = new[0][keep], new[1][keep]
            held = np.concatenate([self.best[q][0], self.fresh[q][0]])
            if len(held) >= self.k:
                self.worst[q] = max(self.worst[q], np.partition(held, len(held) - self.k)[len(held) - self.k])

    def keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Adds a block's results of a query, by ids."""
        s, i = np.concatenate([self.best[q][0], scores]), np.concatenate([self.best[q][1], ids])
        first = np.lexsort((i, -s))[: self.k]
        self.best[q] = s[first], i[first]


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as bytes of 64-bit integers without zeros at the end."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND NOT exists(x, e -> e IS NULL)")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = b.column(1)
        flat, at = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy() - x.offsets[0].as_py()
        whole = np.floor(scale * flat)
        ok, out = [], []
        for lo, hi in zip(at, at[1:]):
            fine = bool((np.abs(whole[lo:hi]) < 2**62).all())
            ok.append(fine)
            v = whole[lo:hi].astype(np.int64) if fine else np.zeros(0, np.int64)
            last = np.flatnonzero(v)
            out.append(v[: last[-1] + 1].tobytes() if len(last) else b"")
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(by_batch(run), "id long, v binary")


def _blocked(rows: DataFrame, pivots: np.ndarray, dim: int, size: int) -> DataFrame:
    """rows (v, ...) as (block, rows): near the same pivot, and at most about `size` together."""
    mid = pivots.astype(float)

    def nearest(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _padded(b.column(0).to_pylist(), dim).astype(float)
        cell = ((mid**2).sum(1)[None, :] - 2 * x @ mid.T).argmin(1)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], names=[*b.schema.names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    celled = rows.mapInArrow(by_batch(nearest), f"{schema}, cell long")
    parts = {r["cell"]: -(-r["n"] // size) for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many as pivots at most
    split = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("cell")) if parts else F.lit(1)
    return celled.groupBy(F.xxhash64("cell", F.pmod(F.xxhash64("v"), split)).alias("block")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))


def _floors(points: np.ndarray, pivots: np.ndarray, reach: list[int], k: int) -> np.ndarray:
    """Each query's k-th score among the pivots, which have so many ids each."""
    if sum(reach) < k:
        return np.full(len(points), np.iinfo(np.int64).min)
    known = np.repeat(products(points, pivots), reach, axis=1)
    return np.partition(known, known.shape[1] - k, 1)[:, known.shape[1] - k]


def _treed(blocks: DataFrame, dim: int, pivots: np.ndarray, reach: list[int], k: int, queries: bool) -> DataFrame:
    """Blocks (block, rows) as (block, v, ids, floor, tree), in order of their trees."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for block, rows in zip(b.column(0).to_pylist(), b.column(1)):
            v = rows.values.field(0).to_pylist()
            points = _padded(v, dim)
            order, nodes = cover_tree(points)
            ids = None if queries else [rows.values.field(1)[int(i)].as_py() for i in order]
            floor = _floors(points[order], pivots, reach, k).tolist() if queries else None
            out.append((block, [v[i] for i in order], ids, floor, nodes.tobytes()))
        types = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "v", "ids", "floor", "tree"])

    return blocks.select("block", "rows").mapInArrow(by_batch(run), "block long, v array<binary>, ids array<array<bigint>>, floor array<bigint>, tree binary")


def _bounds(b: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, float]]:
    """The centre and radius of each block."""
    for k in range(b.num_rows):
        root = np.frombuffer(b.column("tree")[k].as_py(), float)[:2]
        yield _padded([b.column("v")[k].values[int(root[0])].as_py()], dim)[0].astype(float), float(root[1])


def _searched(dealt: DataFrame, dim: int, k: int) -> DataFrame:
    """(v, best) of query blocks and candidate blocks (key, kind, v, ids, floor, tree) that share a key; query blocks come first."""

    def finished(held: list) -> Iterator[pa.RecordBatch]:
        for v, search in held:
            best = [[{"s": int(s), "id": int(i)} for s, i in zip(*pair)] for pair in search.best]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(best, pa.list_(pa.struct([("s", pa.int64()), ("id", pa.int64())])))], names=["v", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in range(b.num_rows):
                key, kind = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                if key != now:
                    yield from finished(held)
                    now, held = key, []
                v = b.column(2)[r].values.to_pylist()
                tree = Tree(_padded(v, dim), np.frombuffer(b.column(5)[r].as_py(), float).reshape(-1, 6))
                if kind == 0:
                    held.append((v, Search(tree, b.column(4)[r].values.to_numpy(), k)))
                    continue
                ids = b.column(3)[r].as_py()
                least = np.array([i[0] for i in ids])
                for _, search in held:
                    for q, (scores, places) in enumerate(search.run(tree, least)):
                        if len(scores):
                            many = [len(ids[x]) for x in places]
                            search.keep(q, np.repeat(scores, many), np.array([i for x in places for i in ids[x]]))
        yield from finished(held)

    return dealt.mapInArrow(run, "v binary, best array<struct<s: bigint, id: bigint>>")


def _merged(parts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k of lists of (score, id) by key."""
    best = F.expr(f"slice(array_sort(flatten(collect_list(best)), (l, r) -> CASE WHEN l.s > r.s THEN -1 WHEN l.s < r.s THEN 1 WHEN l.id < r.id THEN -1 WHEN l.id > r.id THEN 1 ELSE 0 END), 1, {k})")
    return parts.groupBy(*keys).agg(best.alias("best"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k highest products of the rows whose id `every` divides, ties to smaller ids."""
    spark, folder = vectors.sparkSession, shared_dir(vectors.sparkSession)
    rows = stored(quantised(vectors, id_col, vec_col, scale), folder, "rows")
    own = rows.distinct().groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    more = k + (own or 1)  # a query's own id is taken out at last, with each of its vectors

    def combine(b: pa.RecordBatch) -> pa.RecordBatch:
        ids: dict[bytes, set] = {}
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.setdefault(v, set()).add(i)
        return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array([sorted(x)[:more] for x in ids.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    cands = rows.mapInArrow(by_batch(combine), "v binary, ids array<bigint>").groupBy("v").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(ids)))), 1, {more})").alias("ids"))
    cands = stored(cands, folder, "cands")
    queries = stored(rows.where(F.col("id") % every == 0).select("id", "v"), folder, "queries")
    removed(spark, f"{folder}/rows")
    facts = cands.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("v")), F.lit(0)).alias("bytes")).first()
    dim = max(1, facts["bytes"] // 8)
    sample = cands.orderBy(F.xxhash64("v"), "v").limit(max(1, min(PIVOTS, facts["n"] // candidate_block + more))).collect()
    pivots = _padded([r["v"] for r in sample], dim)
    reach = [len(r["ids"]) for r in sample]
    nothing = cands.selectExpr("0L AS block", "array(struct(v, ids)) AS rows")
    blocks = stored(_treed(_blocked(cands, pivots, dim, candidate_block) if len(sample) else nothing, dim, pivots, reach, more, False), folder, "blocks")
    asked = stored(_treed(_blocked(queries.select("v").distinct(), pivots, dim, query_block) if len(sample) else nothing, dim, pivots, reach, more, True), folder, "asked")
    sides = max(1, min(blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = max(1, -(-asked.count() // QUERY_BLOCKS))
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)))
    goals = None
    if asked.count() * 8 * (dim + 3) <= CENTRE_BYTES:

        def summed(b: pa.RecordBatch) -> pa.RecordBatch:
            facts = [(g, c.tobytes(), r, min(f)) for g, (c, r), f in zip(b.column("grp").to_pylist(), _bounds(b, dim), b.column("floor").to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*facts), (pa.int64(), pa.binary(), pa.float64(), pa.int64()))], names=["grp", "c", "r", "f"])

        known = asked.mapInArrow(by_batch(summed), "grp long, c binary, r double, f long").collect()  # below the bound just measured
        if known:
            goals = (np.array([r["grp"] for r in known]), np.stack([np.frombuffer(r["c"], float) for r in known]), np.array([r["r"] for r in known]), np.array([r["f"] for r in known], float))

    def wanted(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for c, r in _bounds(b, dim):
            if goals is None:
                out.append(list(range(groups)))
                continue
            grp, centre, radius, floor = goals
            most = centre @ c + np.sqrt((centre**2).sum(1)) * r + np.sqrt((c**2).sum()) * radius + radius * r
            out.append(np.unique(grp[most + 1e-6 * np.abs(most) + 1e-6 >= floor]).tolist())
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], names=[*b.schema.names, "grps"])

    schema = "block long, v array<binary>, ids array<array<bigint>>, floor array<bigint>, tree binary"
    sent = blocks.mapInArrow(by_batch(wanted), f"{schema}, grps array<bigint>").select(F.explode("grps").alias("grp"), F.pmod(F.xxhash64("block"), F.lit(sides)).alias("side"), F.lit(1).alias("kind"), "v", "ids", "floor", "tree")
    held = asked.select("grp", F.explode(F.expr(f"sequence(0L, {sides - 1}L)")).alias("side"), F.lit(0).alias("kind"), "v", "ids", "floor", "tree")
    dealt = held.unionByName(sent).select((F.col("grp") * sides + F.col("side")).alias("key"), "kind", "v", "ids", "floor", "tree")
    dealt = dealt.repartition(min(groups * sides, 8 * sides), "key").sortWithinPartitions("key", "kind")
    best = stored(_merged(_searched(dealt, dim, more), ["v"], more), folder, "best")
    out = queries.distinct().join(best, "v").select("id", F.expr("filter(best, x -> x.id != id)").alias("best"))
    out = _merged(out, ["id"], k)
    removed(spark, f"{folder}/blocks", f"{folder}/asked", f"{folder}/cands")
    out = out.select(F.col("id").alias("query_id"), F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias(id_col), F.col("b.s").alias("score"))
