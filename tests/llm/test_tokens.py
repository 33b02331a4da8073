"""Token counts and byte-level BPE against the libraries that define them."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from bandscan.llm.byte_codec import ByteCodec, chunked, decoded, encoded, round_trip, stitched, tokenised
from bandscan.llm.queries import BYTE_RANKS, PIECE_MODEL, tokenizer_path
from bandscan.llm.token_count import token_counts

RANKS, MODEL = tokenizer_path(BYTE_RANKS), tokenizer_path(PIECE_MODEL)
ODD = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ñ", "1", "٣", "²", "_", "中", "😀", "\x00", "\x1c", "\x85", "\xa0", " ", "　", "​", "▁", "'", "Ⅷ", "़", ".", "-", "\r\n", "<s>", "</s>", "<0x0A>"]


def odd(rng, n=14):
    return "".join(rng.choice(ODD) for _ in range(rng.randint(0, n)))


@pytest.fixture(scope="module")
def reference():
    code = ByteCodec(RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=code.ranks, special_tokens={})
    return code, lambda s: np.array(lib.encode_ordinary(s), "<u4").tobytes()


def test_chunks_stitch_to_the_whole(reference):
    code, want = reference
    rng = random.Random(2)
    for _ in range(3000):
        s = odd(rng)
        parts = [(b, p, *code.encode_chunk(p, b)) for b, p in chunked(s, rng.randint(1, 6), rng.randint(1, 5))]
        assert stitched(code, parts) == code.encode(s) == want(s)
        assert code.decode(want(s)).decode() == s


def test_code_points(reference):
    code, want = reference
    for cp in range(0, 0x30000, 5):
        if not 0xD800 <= cp < 0xE000:
            s = "a" + chr(cp) + "1" + chr(cp) + " x"
            assert code.encode(s) == want(s), hex(cp)


def test_codec_operator(spark, reference):
    code, want = reference
    rng = random.Random(4)
    texts = [None, "", "x" * 5000, " " * 3000, "ab cd\n" * 900, *(odd(rng, 60) for _ in range(40))]
    rows = [*enumerate(texts), (7, texts[7]), (2, texts[2])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, round_trip(df, RANKS, public_tokenizers.PATTERN, chunk=500, overlap=40).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((i, len(want(t or "")) // 4, sha(want(t or "")), sha((t or "").encode())) for i, t in rows)
    back = decoded(encoded(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {(r[0], bytes(r[1]).decode()) for r in back.collect()} == {(i, t or "") for i, t in rows}
    assert all(sha(code.decode(bytes(r["ids"]))) == r["decoded_sha256"] for r in tokenised(df, RANKS, public_tokenizers.PATTERN).collect())
    assert round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = [None, "", " ", "  a  b ", "x" * 9000, "the " * 3000, "a\n\n b\n", *(odd(rng, 40) for _ in range(400))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "y")], "doc_id long, text string, n_bytes string")
    got = sorted(map(tuple, token_counts(df, MODEL).collect()))
    n = [len(sp.encode(t)) if t else 0 for t in texts]
    assert got == sorted([(i, len((t or "").encode()), n[i], n[i] > 4096) for i, t in enumerate(texts)] + [(0, 0, 0, False)])
    assert token_counts(df.limit(0), MODEL).count() == 0
