"""Patterns against texts: pairing, chunking, scan, and the merge of chunk results.

A text of up to a chunk is scanned by one task and its pairs need no shuffle.
Longer texts are cut into chunks, which are dealt out over all tasks, and only
chunk summaries (lowest score, its positions, hits, last score) are merged.
Inside a task, texts are cut again into short pieces that overlap, so that
thousands of lanes of like length run in lockstep in numpy; short patterns can
instead stay in SQL (engine 'sql'). Patterns go to every task, because every
pattern meets every text: while their measured size is below a bound they
travel with the task, beyond it one block of them after the other meets the
texts. Short texts are dealt out over all tasks; equal ones, and equal patterns,
are scanned once and carry lists of their ids, which become rows at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.functions import sqlkernel
from bandscan.functions.lockstep import Patterns, crossed_scores, symbols
from bandscan.functions.metrics import checked
from bandscan.functions.text import list_text
from bandscan.plans.chunking import with_chunks

#: Symbols of a chunk that one task scans, of a piece of it, lanes of a batch, and scores held at once.
CHUNK, PIECE, LANES, CELLS = 1 << 18, 1024, 8_192, 1 << 24
#: Bytes of patterns that travel with a task, and of a block of more patterns.
CLOSURE_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: Characters of a piece in SQL.
SQL_PIECE = 256
#: Bytes of patterns whose masks are broadcast in SQL.
SQL_BROADCAST = 1 << 18
#: Symbols of a text up to which equal texts are scanned once, the range of ids that one list covers, ids of a list of patterns and of an Arrow batch.
SHORT, RANGE, LISTED, BATCH_IDS = 256, 1 << 16, 1000, 1 << 20
#: Ids below which lists of one value become one, the range of ids it then covers (so it has at most RANGE of them), and pairs that one row of lists stands for.
FEW, SPAN, PAIRS = 256, 1 << 24, 1 << 16

KEYS = "pattern_id long, text_id long, m int, n long, start long, low int, "
PART = KEYS + "low_at array<long>, hits array<long>, last int"
COUNTED = KEYS + "n_low long, n_hits long, last int"


def _lists(key: np.ndarray, pos: np.ndarray, n: int) -> pa.Array:
    """The positions of each key in order, as a list column of n rows."""
    order = np.lexsort((pos, key))
    ends = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order], pa.int64()))


def alike(rows: DataFrame, key: str = "text_id", value: str = "text") -> DataFrame:
    """(ids, value): each value once for each range of ids, so that no list or task grows with a very frequent value.

    Dealt out to a number of partitions of its own, because AQE would join small
    ones although a scan's work is not in its bytes.
    """
    rows = rows.where(f"{value} IS NOT NULL").selectExpr(f"cast({key} AS long) AS id", value).withColumn("range", F.floor(F.col("id") / RANGE))
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), value, "range")
    return dealt.groupBy(value, "range").agg(F.expr("collect_list(struct(id)).id").alias("ids")).select("ids", value)


def gathered(lists: DataFrame, value: str = "text") -> DataFrame:
    """Rows of alike() whose short lists of one value are one list for each SPAN of ids.

    Else a value that stands a few times in each of many ranges would be scanned for each of them.
    """
    few = F.size("ids") < FEW
    lists = lists.withColumn("few", few).withColumn("at", F.floor(F.element_at("ids", 1) / F.when(few, SPAN).otherwise(RANGE)))
    dealt = lists.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), value, "few", "at")
    return dealt.groupBy(value, "few", "at").agg(F.flatten(F.collect_list("ids")).alias("ids")).select("ids", value)


def _each(pairs: DataFrame) -> DataFrame:
    """Rows whose pattern_id and text_id are lists, as a row for each pair."""
    rest = [c for c in pairs.columns if c not in ("pattern_id", "text_id")]
    out = pairs.select(F.explode("pattern_id").alias("pattern_id"), "text_id", *rest)
    return out.select("pattern_id", F.explode("text_id").alias("text_id"), *rest)


def _with_ids(rows: pa.RecordBatch, ids: tuple[pa.ListArray, pa.ListArray]) -> Iterator[pa.RecordBatch]:
    """rows with lists of ids in place of the numbers of their patterns and texts, a bounded number of ids a batch.

    A row repeats with pieces of its text's list, because Spark holds all pairs of a row of lists at once.
    """
    of = [rows.column(k).to_numpy() for k in (0, 1)]
    sizes = [np.diff(x.offsets.to_numpy()).astype(np.int64) for x in ids]
    size = max(1, PAIRS // int(sizes[0].max(initial=1)))
    pieces, start = -(-sizes[1] // size), ids[1].offsets.to_numpy()[:-1].astype(np.int64)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(first, pieces)) * size
    cut = pa.ListArray.from_arrays(pa.array(np.append(begin, ids[1].offsets[-1].as_py()), pa.int32()), ids[1].values)
    ends = np.cumsum(pieces[of[1]] * sizes[0][of[0]] + sizes[1][of[1]])
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, BATCH_IDS + (ends[lo - 1] if lo else 0), "right")))
        some = rows.slice(lo, hi - lo)
        times = pieces[of[1][lo:hi]]
        row = np.repeat(np.arange(hi - lo), times)
        piece = first[of[1][lo:hi]][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        lists = [ids[0].take(pa.array(of[0][lo:hi][row])), cut.take(pa.array(piece))]
        yield pa.RecordBatch.from_arrays([*lists, *(some if len(row) == hi - lo else some.take(pa.array(row))).columns[2:]], names=rows.schema.names)
        lo = hi


class Scanner:
    """Scans chunks with a list of (id, pattern); results: 'lists', 'counts', or 'scores' for lists and all scores."""

    def __init__(self, patterns: list, metric: str, unit: str, anchor: str, results: str):
        self.options, self.unit, self.results, self.anchor = (metric, anchor), unit, results, anchor
        seqs = symbols([p for _, p in patterns], unit)
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(seqs):
            if len(s):
                by_size.setdefault(next(b for b in (16, 32, 64 * -(-len(s) // 64)) if len(s) <= b), []).append(k)
        self.groups = [(np.array([patterns[k][0] for k in ks], np.int64), Patterns([seqs[k] for k in ks])) for ks in by_size.values()]

    def run(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chunks (text_id, n, start, own_len, lead, piece) to rows of PART or COUNTED, a few texts and patterns at a time."""
        facts = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
        own, texts = facts[3], symbols(b.column(5).to_pylist(), self.unit)
        at = np.cumsum([0, *map(len, texts)])
        flat = np.concatenate(texts)
        for ids, patterns in self.groups:
            codes, lo = patterns.encoded(flat), 0
            while lo < len(own):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(own[lo:] + 1), CELLS // len(ids), "right")) + lo)
                some = max(1, min(len(ids), LANES, CELLS // int(own[lo:hi].sum() + 1)))
                for k in range(0, len(ids), some):
                    yield self.block(patterns, ids, np.arange(k, min(k + some, len(ids))), codes, at[lo:hi], *(x[lo:hi] for x in facts))
                lo = hi

    def block(self, patterns, all_ids, which, codes, at, text_id, n, start, own, lead) -> pa.RecordBatch:
        """All patterns of which by some chunks, cut into pieces that read as far back as a score depends on."""
        width, rows = len(which), len(own)
        size = PIECE if self.anchor == "any" else int(own.max(initial=1)) + 1
        pieces = np.maximum(1, -(-own // size))
        row = np.repeat(np.arange(rows), pieces)
        first = np.cumsum(pieces) - pieces
        begin = lead[row] + (np.arange(len(row)) - first[row]) * size
        end = np.minimum(begin + size, lead[row] + own[row])
        back = 2 * int(patterns.lengths[which].max()) if self.anchor == "any" else 0
        read = np.maximum(0, begin - back)
        m = patterns.lengths[which].astype(np.int64)
        low, last = np.empty((len(row), width), np.int64), np.full((len(row), width), -1, np.int64)
        n_low, n_hits = np.zeros((len(row), width), np.int64), np.zeros((len(row), width), np.int64)
        ties, values = [], []
        order = np.argsort((end - read) * (1 << 20) + (begin - read), kind="stable")
        per = max(1, LANES // width)
        for k in range(0, len(order), per):
            g = order[k : k + per]
            steps = int((end[g] - read[g]).max())
            step = np.arange(steps)[:, None]
            here = np.minimum(at[row[g]] + read[g] + step, max(0, len(codes) - 1))
            got = crossed_scores(patterns, which, np.where(step < end[g] - read[g], codes[here] if len(codes) else 0, len(patterns.alphabet)), *self.options)
            got = got.reshape(steps, len(g), width)
            a, z = begin[g] - read[g], end[g] - read[g]
            some = np.flatnonzero(z > a)
            last[g[some]] = got[z[some] - 1, some]
            if self.results == "scores":
                values += [got[a[i] : z[i], i].T for i in range(len(g))]
            if (a == a[0]).all() and (z == z[0]).all():
                got, a0 = got[a[0] : z[0]], int(a[0])
            else:
                got[(step < a) | (step >= z)], a0 = np.iinfo(got.dtype).max, 0
            best = np.minimum(got.min(0, initial=np.iinfo(got.dtype).max), m)
            equal = got == best.astype(got.dtype)
            low[g] = best
            n_low[g] = np.add.reduce(equal.view(np.int8), axis=0, dtype=np.int32)
            if self.results != "counts":
                s, i, p = np.nonzero(equal)
                ties.append((g[i], p, start[row[g[i]]] - lead[row[g[i]]] + read[g[i]] + a0 + s))
        n_hits[low == 0] = n_low[low == 0]
        row_low = np.minimum.reduceat(low, first)
        mine = low == row_low[row]
        table = [np.tile(all_ids[which], rows), np.repeat(text_id, width), np.tile(m, rows).astype(np.int32), np.repeat(n, width), np.repeat(start, width), row_low.ravel().astype(np.int32)]
        names = ["pattern_id", "text_id", "m", "n", "start", "low"]
        if self.results == "counts":
            lists = [np.add.reduceat(np.where(mine, n_low, 0), first).ravel(), np.add.reduceat(n_hits, first).ravel()]
            names += ["n_low", "n_hits", "last"]
        else:
            sub, p, pos = (np.concatenate(x) for x in zip(*ties))
            keep = mine[sub, p]
            key, pos = row[sub[keep]] * width + p[keep], pos[keep]
            hit = row_low.ravel()[key] == 0
            lists = [_lists(key, pos, rows * width), _lists(key[hit], pos[hit], rows * width)]
            names += ["low_at", "hits", "last"]
        cols = [*(pa.array(x) for x in table), *(x if isinstance(x, pa.Array) else pa.array(x) for x in lists), pa.array(last[first + pieces - 1].ravel(), pa.int32())]
        if self.results == "scores":
            of = np.empty(len(order), object)
            for i, v in zip(order, values):
                of[i] = v
            cells = [np.concatenate([of[i][k] for i in range(first[r], first[r] + pieces[r])]) for r in range(rows) for k in range(width)]
            ends = np.cumsum([0, *map(len, cells)])
            cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cells), pa.int32())))
            names.append("scores")
        return pa.RecordBatch.from_arrays(cols, names=names)


def _sized(patterns: DataFrame, unit: str) -> tuple[int, int, int]:
    """(patterns, bytes, longest) of the patterns that have a symbol."""
    length = "char_length" if unit == "char" else "octet_length"
    r = patterns.selectExpr("count(*)", "coalesce(sum(octet_length(pattern)), 0)", f"coalesce(max({length}(pattern)), 0)").first()
    return tuple(int(x) for x in r)


def scanned(patterns: DataFrame, texts: DataFrame, metric: str = "compat", unit: str = "byte", anchor: str = "any", chunk: int = CHUNK, scores: bool = False, counts: bool = False) -> DataFrame:
    """PART rows (COUNTED with counts), one for each pattern (pattern_id, pattern) and chunk of a text (text_id, text).

    texts may already carry start and own_len, its own chunks. Chunks of texts
    that have several are dealt out by text and start. Patterns without a
    symbol and null texts take no part. texts (ids, text) give rows whose
    pattern_id and text_id are lists.
    """
    checked(metric, anchor)
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    patterns = patterns.selectExpr("cast(pattern_id AS long) AS pattern_id", "pattern").where("octet_length(pattern) > 0")
    count, size, longest = _sized(patterns, unit)
    length = "char_length(text)" if unit == "char" else "octet_length(text)"
    texts = texts.where("text IS NOT NULL").withColumn("n", F.expr(f"cast({length} AS long)"))
    grouped = "ids" in texts.columns
    if grouped:
        texts = texts.withColumn("text_id", F.lit(0))
    deal = False
    if "own_len" not in texts.columns:
        deal = anchor == "any" and "__long" in texts.columns
        texts = with_chunks(texts, "n", chunk) if anchor == "any" else texts.withColumn("start", F.lit(0).cast("long")).withColumn("own_len", F.col("n"))
    source = "text" if unit == "char" else "cast(text AS binary)"
    texts = texts.withColumn("lead", F.expr(f"least(start, {2 * longest}L)"))
    pieces = texts.select(F.expr("cast(text_id AS long)").alias("text_id"), "n", "start", "own_len", "lead", F.expr(f"substring({source}, cast(start - lead AS int) + 1, cast(lead + own_len AS int))").alias("piece"), *(["ids"] if grouped else []))
    if deal:
        # a number of its own, because AQE would join small partitions although a scan's work is not in its bytes
        pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "text_id", "start")
    results = "counts" if counts else "scores" if scores else "lists"
    schema = COUNTED if counts else PART + (", scores array<int>" if scores else "")
    if grouped:
        schema = schema.replace("_id long", "_id array<long>")

    def scan(block: DataFrame) -> DataFrame:
        known, lists = [tuple(r) for r in block.collect()], []  # below a bound that has been measured
        if grouped:
            equal: dict = {}
            for i, p in known:
                equal.setdefault(p if isinstance(p, str) else bytes(p), []).append(i)
            lists, values = zip(*((v[k : k + LISTED], p) for p, v in equal.items() for k in range(0, len(v), LISTED)), strict=True) if equal else ((), ())
            known = list(enumerate(values))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner, ids = Scanner(known, metric, unit, anchor, results), pa.array(lists, pa.list_(pa.int64()))
            for b in batches:
                if b.num_rows and not grouped:
                    yield from scanner.run(b)
                elif b.num_rows:
                    numbers = pa.array(np.arange(b.num_rows))
                    for rows in scanner.run(pa.RecordBatch.from_arrays([numbers, *b.columns[1:6]], names=b.schema.names[:6])):
                        yield from _with_ids(rows, (ids, b.column(6)))

        return pieces.mapInArrow(run, schema)

    if size <= CLOSURE_BYTES:
        return scan(patterns)
    blocks = -(-size // BLOCK_BYTES)
    return reduce(DataFrame.unionAll, [scan(patterns.where(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(blocks)) == k)) for k in range(blocks)])


def merged(parts: DataFrame) -> DataFrame:
    """One row for each pair: hits, lowest score and where, last score; an associative merge of chunk results."""
    if "n_low" in parts.columns:
        by_low = parts.groupBy("pattern_id", "text_id", "m", "n", "low").agg(F.sum("n_low").alias("n_low"), F.sum("n_hits").alias("n_hits"), F.max(F.struct("start", "last")).alias("end"))
        return counted(by_low.groupBy("pattern_id", "text_id", "m", "n").agg(F.min_by("n_low", "low").alias("n_low"), F.sum("n_hits").alias("n_hits"), F.min("low").alias("low"), F.max("end").getField("last").alias("last")))
    has_scores = "scores" in parts.columns
    extra = [F.expr("flatten(transform(array_sort(collect_list(struct(start, scores))), x -> x.scores))").alias("scores")] if has_scores else []
    out = parts.groupBy("pattern_id", "text_id", "m", "n").agg(
        F.min("low").alias("low"),
        F.collect_list(F.when(F.size("low_at") > 0, F.struct("low", "low_at"))).alias("lows"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.max_by("last", "start").alias("last"),
        *extra,
    )
    return named(out.withColumn("low_at", F.expr("array_sort(flatten(transform(filter(lows, x -> x.low = low), x -> x.low_at)))")))


def named(pairs: DataFrame) -> DataFrame:
    """PART rows of whole texts under the names of match()."""
    return pairs.select("pattern_id", "text_id", F.col("m").alias("query_len"), F.col("n").alias("ref_len"), F.size("hits").alias("num_hits"), F.col("hits").alias("hit_indexes"), F.col("low").alias("lowest_score"), F.col("low_at").alias("lowest_indexes"), F.col("last").alias("last_score"), *(["scores"] if "scores" in pairs.columns else []))


def counted(pairs: DataFrame) -> DataFrame:
    """COUNTED rows of whole texts under the names of match()."""
    return pairs.select("pattern_id", "text_id", F.col("m").alias("query_len"), F.col("n").alias("ref_len"), F.col("n_hits").cast("int").alias("num_hits"), F.col("low").alias("lowest_score"), F.col("n_low").cast("int").alias("n_lowest"), F.col("last").alias("last_score"))


def match(patterns: DataFrame, texts: DataFrame, metric: str = "compat", unit: str = "byte", anchor: str = "any", chunk: int = CHUNK, scores: bool = False, max_positions: int | None = None, engine: str = "lockstep", counts: bool = False, listed: bool = False) -> DataFrame:
    """Every pattern against every text.

    Columns: pattern_id, text_id, query_len, ref_len, num_hits, hit_indexes,
    lowest_score, lowest_indexes, last_score (-1 for an empty text) and, if
    asked, scores. Positions are 0-based ends. max_positions cuts the lists.
    counts: n_lowest, how often the lowest score occurs, stands for the lists,
    which are never made. listed: lists as text. Only pairs of texts longer than
    a chunk are merged; equal texts of up to SHORT symbols are scanned once.
    """
    texts = texts.select("text_id", "text")

    def finished(pairs: DataFrame) -> DataFrame:
        for c in ("hit_indexes", "lowest_indexes"):
            if max_positions is not None and not counts:
                pairs = pairs.withColumn(c, F.slice(c, 1, max_positions))
        return flat(pairs) if listed else pairs

    if engine == "sql":
        return reduce(DataFrame.unionByName, _match_sql(patterns, texts, metric, anchor, scores, finished))
    options, whole = (metric, unit, anchor, chunk, scores, counts), counted if counts else named
    length = "char_length(text)" if unit == "char" else "octet_length(text)"
    short = SHORT if anchor == "start" else min(chunk, SHORT)
    short_lists = finished(whole(scanned(patterns, gathered(alike(texts.where(f"{length} <= {short}"))), *options)))
    out = []
    if anchor == "start":
        out.append(finished(whole(scanned(patterns, texts.where(f"{length} > {short}"), *options))))
    else:
        if short < chunk:
            out.append(finished(whole(scanned(patterns, texts.where(f"{length} > {short} AND {length} <= {chunk}"), *options))))
        out.append(finished(merged(scanned(patterns, texts.where(f"{length} > {chunk}").withColumn("__long", F.lit(True)), *options))))
    # ids become rows above the union: below it, each would be copied even where only a count of them is wanted
    ids = ("pattern_id", "text_id")
    return _each(reduce(DataFrame.unionByName, [short_lists, *(pairs.withColumns({c: F.array(c) for c in ids}) for pairs in out)]))


def flat(pairs: DataFrame) -> DataFrame:
    """Lists as text, so that results compare as plain values."""
    for c, kind in pairs.dtypes:
        if c in ("hit_indexes", "lowest_indexes", "scores") and kind != "string":
            pairs = pairs.withColumn(c, list_text(F.col(c)))
    return pairs


def chunk_matches(patterns: DataFrame, texts: DataFrame, metric: str = "compat", unit: str = "byte", chunk: int = CHUNK) -> DataFrame:
    """As match(), but a row for each pair and chunk with some position: start, its own lowest score, positions and hits.

    For results whose lists over a whole text would not fit a row.
    """
    return scanned(patterns, texts.select("text_id", "text").withColumn("__long", F.lit(True)), metric, unit, chunk=chunk)


def _match_sql(patterns: DataFrame, texts: DataFrame, metric: str, anchor: str, scores: bool, finished) -> list[DataFrame]:
    """By aggregate() in SQL, in characters; patterns of up to 60. Texts are cut into pieces, so that work is linear in their length."""
    patterns = patterns.where("octet_length(pattern) > 0").select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern")
    small = _sized(patterns, "char")[1] <= SQL_BROADCAST
    masks = lambda p: p.withColumn("m", F.char_length("pattern")).withColumn("eq", sqlkernel.match_masks("pattern"))
    sized = lambda t: t.withColumn("n", F.char_length("text").cast("long"))

    def parts(t: DataFrame, p: DataFrame = patterns) -> DataFrame:
        p = F.broadcast(masks(p)) if small else masks(p)
        pairs = t.crossJoin(p).withColumn("lead", F.expr("least(start, 2L * m)"))
        pairs = pairs.withColumn("piece", F.expr("substring(text, cast(start - lead AS int) + 1, cast(lead + own_len AS int))"))
        all_scores = sqlkernel.score_array("eq", "m", "piece", metric, anchor)
        pairs = pairs.select("pattern_id", "text_id", "m", "n", "start", F.assert_true(F.col("m") <= sqlkernel.MAX_SYMBOLS).alias("ok"), F.slice(all_scores, F.expr("cast(lead AS int) + 1"), F.greatest(F.lit(1), F.col("own_len").cast("int"))).alias("scores"))
        pairs = pairs.where("ok IS NULL").withColumn("low", F.least(F.col("m"), F.coalesce(F.array_min("scores"), F.col("m"))))
        at = lambda v: F.expr(f"filter(transform(scores, (s, j) -> IF(s = {v}, start + j, NULL)), j -> j IS NOT NULL)")
        return pairs.select("pattern_id", "text_id", "m", "n", "start", "low", at("low").alias("low_at"), at("0").alias("hits"), F.coalesce(F.try_element_at("scores", F.lit(-1)), F.lit(-1)).alias("last"), *(["scores"] if scores else []))

    whole = lambda t: sized(t).withColumn("start", F.lit(0).cast("long")).withColumn("own_len", F.col("n"))
    short, long = (texts.where(f"text IS NOT NULL AND char_length(text) {k} {SQL_PIECE}").select(F.col("text_id").cast("long").alias("text_id"), "text") for k in ("<=", ">"))
    lists = alike(patterns, "pattern_id", "pattern").withColumnRenamed("ids", "pattern_id")
    out = _each(finished(named(parts(whole(alike(short).withColumnRenamed("ids", "text_id")), lists))))
    if anchor == "start":
        return [out, finished(named(parts(whole(long))))]
    return [out, finished(merged(parts(with_chunks(sized(long), "n", SQL_PIECE))))]


def reported(pairs: DataFrame) -> DataFrame:
    """As a report prints it: with hits, the lowest score and its positions are missing."""
    for c in ("lowest_score", "lowest_indexes"):
        pairs = pairs.withColumn(c, F.when(F.col("num_hits") == 0, F.col(c)))
    return pairs


def first_lowest(pairs: DataFrame) -> DataFrame:
    """Only the first position of the lowest score."""
    return pairs.withColumn("first_lowest", F.try_element_at("lowest_indexes", F.lit(1)))
