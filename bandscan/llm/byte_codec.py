"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to `chunk` characters are encoded where they are read. A longer
one is cut into chunks that overlap; tasks pre-tokenise and encode the chunks
independently, and the pieces are stitched per document: the pre-tokeniser
carries no state from one match to the next, so from the first boundary that
two neighbouring chunks share, the later chunk's matches are those of the
whole text. A boundary is trusted only if it lies before its chunk's end. When
an overlap has no shared boundary (one match longer than it), the text from
the last trusted boundary on is matched again over both chunks.

The pattern is taken apart in two steps with the same result: units (a run of
non-space characters with at most one space before it, or a run of white
space) never split or join a match of the pattern, and recur so often that a
bounded memo holds their identifiers.

Defined results: a null or empty text has no identifiers and the digest of
nothing; repeated rows each give a row; an empty table an empty result; other
columns are ignored. A document id must not repeat among texts longer than a
chunk with different texts; equal rows there give one row each.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.llm.bpe import Memo, merges
from bandscan.llm.common import by_batch

CHUNK, OVERLAP = 65_536, 4_096

#: The code points of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class ByteCodec:
    """Encodes and decodes with a rank file and a pre-token pattern."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.units = Memo(self.encode_unit, 700_000)

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        cuts = bytearray(b"\1") * (len(piece) + 1)
        merges(piece, self.ranks.get, cuts)
        at = [k for k, cut in enumerate(cuts) if cut]
        return [self.ranks[piece[a:b]] for a, b in zip(at, at[1:])]

    def encode_unit(self, unit: str) -> bytes:
        return np.array([i for p in self.pieces(unit) for i in self.encode_piece(p.encode("utf-8", "replace"))], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Identifiers as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.units.__getitem__, UNIT.findall(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_chunk(self, text: str, base: int) -> tuple[list[int], list[int], bytes]:
        """Where the chunk's units start and the last ends, in the text; where their identifiers start; these."""
        starts, sizes, parts = [base], [0], []
        for m in UNIT.finditer(text):
            parts.append(self.units[m[0]])
            starts.append(base + m.end())
            sizes.append(sizes[-1] + len(parts[-1]))
        return starts, sizes, b"".join(parts)


@functools.lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> ByteCodec:
    """One for each Python worker, kept between tasks."""
    return ByteCodec(rank_file, pattern)


def chunked(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset, slice) of the chunks; every one but the last reads `overlap` characters of the next."""
    for base in range(0, max(1, len(text)), chunk):
        yield base, text[base : base + chunk + overlap]


def stitched(code: ByteCodec, chunks: list[tuple[int, str, list[int], list[int], bytes]]) -> bytes:
    """A text's identifiers from its chunks (offset, slice, starts, sizes, identifiers), in order."""
    out: list[bytes] = []
    base, text, starts, sizes, ids = chunks[0]
    at = 0  # index of the first unit of this chunk that is still to be taken
    for after in chunks[1:]:
        later = after[2]
        ends = set(later[:-1])
        last = len(starts) - 1 - (starts[-1] == base + len(text))  # the last boundary that is trusted
        join = next((k for k in range(max(at, bisect.bisect_left(starts, after[0])), last + 1) if starts[k] in ends), None)
        if join is None:  # no shared boundary: match again from the last trusted one
            begin = max(at, last)
            out.append(ids[sizes[at] : sizes[begin]])
            text = text[starts[begin] - base :] + after[1][base + len(text) - after[0] :]
            base, at = starts[begin], 0
            starts, sizes, ids = code.encode_chunk(text, base)
            continue
        out.append(ids[sizes[at] : sizes[join]])
        at = bisect.bisect_left(later, starts[join])
        base, text, starts, sizes, ids = after
    out.append(ids[sizes[at] :])
    return b"".join(out)


def _apply(docs: DataFrame, finish, schema: str, rank_file: str, pattern: str, id_col: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """finish(codec, ids) gives the columns that follow the id."""
    id_type = docs.schema[id_col].dataType.simpleString()
    out_schema = f"`{id_col}` {id_type}, {schema}"
    docs = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    names = [x.split()[0] for x in schema.split(",")]

    def short(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = codec(rank_file, pattern)
        rows = [finish(code, code.encode(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows))], names=[id_col, *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                for base, part in chunked(text, chunk, overlap):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(2).slice(k, 1), pa.array([base], pa.int64()), pa.array([part])], names=["id", "row", "base", "part"])

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = codec(rank_file, pattern)
        done = [code.encode_chunk(t, b) for b, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        cols = [[np.array(s, "<i8").tobytes() for s, _, _ in done], [np.array(z, "<i8").tobytes() for _, z, _ in done], [i for _, _, i in done]]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.binary()) for c in cols)], names=["id", "row", "base", "part", "starts", "sizes", "ids"])

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        code, rows = codec(rank_file, pattern), rows.sort_values("base")
        load = lambda x: np.frombuffer(x, "<i8").tolist()
        chunks = [(b, p, load(s), load(z), i) for b, p, s, z, i in zip(rows["base"], rows["part"], rows["starts"], rows["sizes"], rows["ids"])]
        return pd.DataFrame([[rows["id"].iloc[0], *finish(code, stitched(code, chunks))]], columns=[id_col, *names])

    long = docs.where(F.length("__text") > chunk).withColumn("__row", F.monotonically_increasing_id())
    parts = long.mapInArrow(cut, f"id {id_type}, row long, base long, part string").repartition("id", "base")
    parts = parts.mapInArrow(by_batch(encode), f"id {id_type}, row long, base long, part string, starts binary, sizes binary, ids binary")
    whole = docs.where(F.length("__text") <= chunk).mapInArrow(by_batch(short), out_schema)
    return whole.unionAll(parts.groupBy("id", "row").applyInPandas(stitch, out_schema))


def encoded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids): the identifiers as little-endian unsigned 32-bit integers."""
    return _apply(docs, lambda code, ids: (len(ids) // 4, ids), "n_tokens long, ids binary", rank_file, pattern, id_col, text_col, chunk, overlap)


def decoded(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the raw bytes that the identifiers stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = codec(rank_file, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    return tokens.select(id_col, ids_col).mapInArrow(by_batch(run), f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, decoded binary")


def _checked(code: ByteCodec, ids: bytes) -> tuple:
    return len(ids) // 4, ids, hashlib.sha256(code.decode(ids)).hexdigest()


def tokenised(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids, decoded_sha256): the identifiers, and a digest of the bytes they decode to."""
    return _apply(docs, _checked, "n_tokens long, ids binary, decoded_sha256 string", rank_file, pattern, id_col, text_col, chunk, overlap)


def _digests(code: ByteCodec, ids: bytes) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what it made, and digests both."""
    return _apply(docs, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", rank_file, pattern, id_col, text_col, chunk, overlap)
