"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of `size` bytes that covers it also starts earlier: in
a document of smaller id, or earlier in the same one. Strings are judged on
the input, overlaps count, and matches never cross documents.

Two equal strings of `size` bytes have the same smallest k-byte gram, so it is
enough to compare strings around the same gram. Each document's anchors are
the grams that are smallest in some window (ties: all of them); its context is
all bytes of the windows around it.

1. Tasks list their texts' anchors: hash of the gram, hash of the context, id,
   position. Of contexts that repeat within a task's block only the earliest
   goes on; the others are known to be covered. Anchors travel as packed
   arrays, by hash bucket.
2. In a bucket, contexts equal to an earlier one are covered. Grams that still
   have several different contexts, which may overlap in part, ask for them.
3. These contexts' bytes are dealt out by gram and concatenated to shards. An
   induced suffix array and permuted common prefixes find the strings of
   `size` bytes that occur more than once; all but the earliest are covered.
   A gram with more than `group` different contexts is not gathered: each of
   its windows becomes an anchor of its own, for step 1's method, where the
   context is the window and equality decides.
4. The covered ranges meet their documents by id, and bytes are removed; other
   documents' texts are not shuffled while the ids of these may be broadcast.

Hashes are 64 bits, compared within equal gram hashes; a window of step 3 is
equal under two of them, one with a random multiplier for each place. Apart from step 4's
join, no text is shuffled but for documents with asked contexts.

Defined results: a null or empty text keeps nothing and loses nothing; a text
shorter than `size` is left alone; rows with equal id and text count as one
document and each get its row; rows of equal id with different texts are taken
as one place in the order, the text with the smaller hash first; a null id
comes before all others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.llm.common import by_batch, given_back, removed, shared_dir, stored, trim
from bandscan.llm.numtext import blocks, mix, place_keys, prefix_sums, span_hash, width_hashes
from bandscan.llm.numtext import BYTES as RANDOM
from bandscan.llm.suffix_array import common_prefixes, suffix_array

SIZE, GRAM, GROUP = 100, 40, 20_000
#: Documents with something to remove whose ids may be broadcast, so that the other texts are not shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of text whose anchors are deduplicated together, and of contexts in a suffix array.
BLOCK, SHARD = 2 << 20, 3 << 19


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def anchors(raw: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, text, position, context start, context end) of texts' anchors."""
    n, width = len(raw), size - gram + 1
    if n < size:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums = prefix_sums(RANDOM[raw])
    h = width_hashes(sums, gram)
    h |= np.uint64(1)
    low = _slide(h, width, np.minimum)  # of the windows that start at 0 .. n - size
    cross = (at[1:-1, None] - np.arange(1, size)).ravel()
    low[cross[(cross >= 0) & (cross < len(low))]] = 0  # windows that cross texts
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    text = np.searchsorted(at, chosen, "right") - 1
    start, stop = np.maximum(at[text], chosen - (size - gram)), np.minimum(at[text + 1], chosen + size)
    c = mix(span_hash(sums, start, stop) ^ (chosen - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h[chosen], c, text, chosen - at[text], start - at[text], stop - at[text]


def _firsts(h: np.ndarray, c: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by hashes and place; in it, where a new h and a new (h, c) begins, and what stands later than the first of its (h, c)."""
    by = np.lexsort((pos, tag, doc, c, h))
    if not len(by):
        return by, *[np.zeros(0, bool)] * 3
    hs, cs = h[by], c[by]
    new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
    new_c = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
    lead = by[np.maximum.accumulate(np.where(new_c, np.arange(len(by)), 0))]
    later = (doc[by] != doc[lead]) | (tag[by] != tag[lead]) | (pos[by] != pos[lead])
    return by, new_h, new_c, later


def _blob(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


#: Packed anchors of a bucket (kind 0), or covered ranges of one document (kind 1).
PACKED = "bucket int, kind int, h binary, c binary, doc binary, tag binary, pos binary, lo binary, hi binary"
FOUND = "kind int, doc long, tag long, h long, pos binary, lo binary, hi binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["bucket", "kind", "h", "c", "doc", "tag", "pos", "lo", "hi"])


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "doc", "tag", "h", "pos", "lo", "hi"])


def _spread(h, c, doc, tag, pos, lo, hi, buckets: int) -> Iterator[tuple]:
    """Rows to send of one block's anchors: the earliest of equal contexts by bucket, the rest as covered ranges."""
    by, _, new_c, later = _firsts(h, c, doc, tag, pos)
    first, rest = by[new_c], by[later]
    bucket = (h[first] >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    first, bucket = first[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for k, part in zip(cut, np.split(first, cut[1:])):
        yield int(bucket[k]), 0, _blob(h[part], "<u8"), _blob(c[part], "<u8"), _blob(doc[part], "<i8"), _blob(tag[part], "<i8"), _blob(pos[part], "<i4"), _blob(lo[part], "<i4"), _blob(hi[part], "<i4")
    if len(rest):
        rest = rest[np.lexsort((lo[rest], tag[rest], doc[rest]))]
        cut = np.flatnonzero(np.concatenate([[True], (doc[rest][1:] != doc[rest][:-1]) | (tag[rest][1:] != tag[rest][:-1])]))
        for part in np.split(rest, cut[1:]):
            i = part[0]
            yield int((int(doc[i]) * 2654435761 >> 8) % buckets), 1, b"", b"", _blob(doc[i : i + 1], "<i8"), _blob(tag[i : i + 1], "<i8"), b"", _blob(lo[part], "<i4"), _blob(hi[part], "<i4")


def _resolved(packed: DataFrame, buckets: int, group: int | None) -> DataFrame:
    """FOUND rows: kind 1 covered ranges; kind 2 contexts asked for; kind 3 such of grams with too many.

    group: None where equality of contexts decides everything.
    """

    def rows_of(parts: list[list[bytes]]) -> Iterator[tuple]:
        h, c, doc, tag, pos, lo, hi = (np.frombuffer(b"".join(p), k) for p, k in zip(parts, ("<u8", "<u8", "<i8", "<i8", "<i4", "<i4", "<i4")))
        once = np.argsort(h)
        same = h[once][1:] == h[once][:-1]
        some = once[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(h) else once
        h, c, doc, tag, pos, lo, hi = (x[some] for x in (h, c, doc, tag, pos, lo, hi))
        by, new_h, new_c, later = _firsts(h, c, doc, tag, pos)
        out = [(1, by[later])]
        if group is not None and len(by):
            gram_of = np.cumsum(new_h) - 1
            contexts = np.bincount(gram_of, new_c)[gram_of]
            out += [(2, by[new_c & (contexts > 1) & (contexts <= group)]), (3, by[new_c & (contexts > group)])]
        for kind, sel in out:
            if not len(sel):
                continue
            sel = sel[np.lexsort((tag[sel], doc[sel]))] if kind == 1 else sel
            if kind == 1:
                cut = np.flatnonzero(np.concatenate([[True], (doc[sel][1:] != doc[sel][:-1]) | (tag[sel][1:] != tag[sel][:-1])]))
                for part in np.split(sel, cut[1:]):
                    yield 1, int(doc[part[0]]), int(tag[part[0]]), 0, b"", lo[part].tobytes(), hi[part].tobytes()
            else:
                for i in sel:
                    yield kind, int(doc[i]), int(tag[i]), int(h[i].astype(np.int64)), pos[i : i + 1].tobytes(), lo[i : i + 1].tobytes(), hi[i : i + 1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, rows = None, [[] for _ in range(7)], []
        for b in batches:
            for bucket, kind, *cols in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 1:
                    rows.append((1, int(np.frombuffer(cols[2], "<i8")[0]), int(np.frombuffer(cols[3], "<i8")[0]), 0, b"", cols[5], cols[6]))
                    continue
                if bucket != now:
                    rows += rows_of(parts)
                    now, parts = bucket, [[] for _ in range(7)]
                for p, x in zip(parts, cols):
                    p.append(x)
                while len(rows) >= 20_000:
                    yield _found(rows[:20_000])
                    rows = rows[20_000:]
        rows += rows_of(parts)
        for k in range(0, len(rows), 20_000):
            yield _found(rows[k : k + 20_000])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(given_back(run), FOUND)


def _windows_packed(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts (h, doc, tag, lo, ctx) to anchors that are whole windows, under two independent hashes."""
    for b in batches:
        h, c, doc, tag, lo = [], [], [], [], []
        for _, d, t, start, ctx in zip(*(c.to_pylist() for c in b.columns)):
            k = np.arange(len(ctx) - size + 1)
            if len(k):
                values = RANDOM[np.frombuffer(ctx, np.uint8)]
                h.append(span_hash(prefix_sums(values), k, k + size))
                c.append(mix(np.lib.stride_tricks.sliding_window_view(values, size) @ place_keys(size)[:size]))
                doc.append(np.full(len(k), d))
                tag.append(np.full(len(k), t))
                lo.append(k + start)
        if h:
            h, c, doc, tag, lo = map(np.concatenate, (h, c, doc, tag, lo))
            rows = list(_spread(h, c, doc, tag, lo, lo, lo + size, buckets))
            if rows:
                yield _packed(rows)


def shard_repeats(h: np.ndarray, doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, contexts: list[bytes], size: int) -> Iterator[tuple]:
    """FOUND rows of the windows of a shard's contexts that also start earlier."""
    lens = np.array([len(c) for c in contexts])
    text = np.zeros(lens.sum() + len(lens) + 1, np.uint8)  # UTF-8 has no bytes above 0xF7
    begin = np.cumsum(lens + 1) - lens - 1
    body = np.ones(len(text), bool)
    body[begin + lens] = body[-1] = False
    text[body] = np.frombuffer(b"".join(contexts), np.uint8) + np.uint8(2)
    text[begin + lens] = 1
    sa = suffix_array(text, 256)
    own = np.append(np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1), np.int32(len(lens) - 1))
    inside = np.arange(size, len(text) + size, dtype=np.int32) <= (begin + lens).astype(np.int32)[own]
    # a string that runs over its context's end equals none inside, so only neighbours inside are compared
    joins = np.append(common_prefixes(text, sa, size, inside)[sa] >= size, False)
    part = np.flatnonzero(joins[:-1] | joins[1:])  # in a run of suffixes with equal first `size` bytes
    if not len(part):
        return
    run = np.cumsum(~joins[part])
    o = own[sa[part]]
    start = lo[o] + sa[part] - begin[o]
    by = np.lexsort((start, tag[o], doc[o], run))
    o, start, run = o[by], start[by], run[by]
    lead = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    first = np.repeat(lead, np.diff(np.concatenate([lead, [len(run)]])))
    later = (doc[o] != doc[o[first]]) | (tag[o] != tag[o[first]]) | (start != start[first])
    o, start = o[later], start[later]
    by = np.lexsort((start, tag[o], doc[o]))
    o, start = o[by], start[by]
    d, t = doc[o], tag[o]
    if not len(o):
        return
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    cut = np.flatnonzero(fresh | np.concatenate([[True], start[1:] > start[:-1] + 1]))
    last = np.concatenate([cut[1:], [len(o)]]) - 1
    los, his = _blob(start[cut], "<i4"), _blob(start[last] + size, "<i4")
    group = np.flatnonzero(fresh[cut])
    ends = np.append(group[1:], len(cut))
    for a, z, i, j in zip((4 * group).tolist(), (4 * ends).tolist(), d[cut[group]].tolist(), t[cut[group]].tolist()):
        yield 1, i, j, 0, b"", los[a:z], his[a:z]


def _sharded(batches: Iterator[pa.RecordBatch], size: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Contexts (h, doc, tag, lo, ctx), sorted by h, to FOUND rows.

    Grams are never split between shards; only a gram that is larger by itself
    makes a shard of more than `shard` bytes, in which there is nothing else.
    """
    held: list[list] = [[], [], [], [], []]
    begin = total = of_gram = 0  # the last gram's first row; bytes of all, and of the last gram

    def flush(rows: list[list]) -> Iterator[pa.RecordBatch]:
        if rows[0]:
            out = list(shard_repeats(*(np.array(x, np.int64) for x in rows[:4]), rows[4], size))
            if sum(map(len, rows[4])) > shard:
                trim()
            if out:
                yield _found(out)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held[0] and row[0] != held[0][-1]:
                begin, of_gram = len(held[0]), 0
            for x, v in zip(held, row):
                x.append(v)
            total, of_gram = total + len(row[4]), of_gram + len(row[4])
            if begin and total > shard:
                yield from flush([x[:begin] for x in held])
                held, begin, total = [x[begin:] for x in held], 0, of_gram
    yield from flush(held)


def _merged(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    flags = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
    step = np.diff(flags)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """The documents' texts with what is removed: (id, text, lo array<int>, hi array<int>), byte ranges."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    least = -(1 << 63)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("doc"), F.xxhash64(text_col).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = texts.where(F.octet_length("text") >= size).select("doc", "tag", "text")
    total = long.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 << 20))

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, _, raw, at in blocks(b.column(2), BLOCK):
                h, c, text, pos, lo, hi = anchors(raw, at, size, gram)
                if len(h):
                    yield _packed(list(_spread(h, c, doc[first + text], tag[first + text], pos, lo, hi, buckets)))

    found = stored(_resolved(long.mapInArrow(given_back(list_anchors), PACKED), buckets, group), folder, "found")
    covered = [found.where("kind = 1")]
    asks = found.where("kind > 1").groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "h", "lo", "hi")).alias("asks"))

    def fetch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, tag, text, asked in zip(*(c.to_pylist() for c in b.columns)):
            raw = text.encode()
            for a in asked:
                lo, hi = int.from_bytes(a["lo"], "little"), int.from_bytes(a["hi"], "little")
                rows.append((a["kind"], a["h"], doc, tag, lo, raw[lo:hi]))
        cols = list(zip(*rows))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "h", "doc", "tag", "lo", "ctx"])

    asked = long.join(asks, ["doc", "tag"]).select("doc", "tag", "text", "asks").mapInArrow(given_back(by_batch(fetch)), "kind int, h long, doc long, tag long, lo long, ctx binary")
    asked = stored(asked, folder, "asked")
    plain = ["h", "doc", "tag", "lo", "ctx"]
    shards = asked.where("kind = 2").select(*plain).repartition("h").sortWithinPartitions("h")
    covered.append(stored(shards.mapInArrow(given_back(lambda it: _sharded(it, size, shard)), FOUND), folder, "shards"))
    if not (deep := asked.where("kind = 3")).isEmpty():
        packed = deep.select(*plain).mapInArrow(given_back(lambda it: _windows_packed(it, size, buckets)), PACKED)
        covered.append(stored(_resolved(packed, buckets, None).where("kind = 1"), folder, "deep"))
    removed(spark, f"{folder}/asked")
    ranges = covered[0]
    for more in covered[1:]:
        ranges = ranges.unionAll(more)
    ranges = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    ranges = stored(ranges, folder, "ranges")
    removed(spark, *(f"{folder}/{x}" for x in ("found", "shards", "deep")))
    if ranges.count() > BROADCAST_IDS:
        return texts.join(ranges, ["doc", "tag"], "left").select("id", "text", "ranges")
    # texts that lose nothing are read where they are; only the others are shuffled to their ranges
    touched = F.broadcast(ranges.select("doc", "tag"))
    whole = texts.join(touched, ["doc", "tag"], "left_anti").select("id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges"))
    return whole.unionAll(texts.join(touched, ["doc", "tag"], "left_semi").join(ranges, ["doc", "tag"]).select("id", "text", "ranges"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, kept, spans): the remaining bytes of each document and the byte ranges removed."""
    span = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
    columns = {"kept": ("binary", pa.binary()), "spans": ("array<struct<lo: int, hi: int>>", pa.list_(span))}
    finish = lambda raw, lo, hi, kept: (kept, [{"lo": int(a), "hi": int(z)} for a, z in zip(lo, hi)])
    return _finished(docs, id_col, text_col, columns, finish, options)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256)."""
    columns = {c: ("long", pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": ("string", pa.string())}
    finish = lambda raw, lo, hi, kept: (len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest())
    return _finished(docs, id_col, text_col, columns, finish, options)


def _finished(docs: DataFrame, id_col: str, text_col: str, columns: dict, finish, options: dict) -> DataFrame:
    """Calls finish(bytes, run starts, run ends, remaining bytes) for each document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = text.encode()
            if not ranges:
                rows.append(finish(raw, (), (), raw))
                continue
            lo, hi = (np.frombuffer(b"".join(r[k] for r in ranges), "<i4") for k in ("lo", "hi"))
            lo, hi = _merged(lo, hi, len(raw))
            edges = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(raw)]])
            rows.append(finish(raw, lo, hi, b"".join(raw[a:z] for a, z in edges.reshape(-1, 2))))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns.values()))], names=[id_col, *columns])

    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *(f"{c} {t}" for c, (t, _) in columns.items())])
    return repeated_spans(docs, id_col, text_col, **options).mapInArrow(given_back(by_batch(run)), schema)
