"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A text's count is its symbols minus the merges made. The vocabulary is a
sentencepiece BPE model with byte fallback: spaces become U+2581, one is put
in front, and a symbol without a piece of its own counts as its UTF-8 bytes.

A merge needs a piece that holds both neighbours, so text may be cut, without
changing any count, between two characters that stand side by side in no
piece: in front of a space that follows something else, around line ends, and
before most punctuation. The cuts make short strings that recur, whose counts
a bounded memo keeps; merging runs once for each of them.

Defined results: a null text counts as empty; an empty text has 0 bytes and 0
tokens; repeated rows each get a row; an empty table gives an empty result;
columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from bandscan.llm.bpe import Memo, merges
from bandscan.llm.common import by_batch

SPACE = "▁"
LIMIT = 4096


class PieceCounter:
    """Counts a text's tokens under a sentencepiece BPE model file."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ranks: dict[str, float] = {}
        self.single: set[str] = set()
        self.pairs: set[str] = set()
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            self.ranks[piece] = -sp.get_score(i)
            self.single.add(piece)
            self.pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
        #: No piece has a space after another character, or touches a line end.
        self.cut_space = not any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        self.cut_line = not any("\n" in p for p in self.pairs)
        self.bare = Memo(self.run)
        self.spaced = Memo(self.run_spaced)
        self.newline = self.run("\n")

    def run(self, s: str) -> int:
        """Tokens of a string, its last characters apart where no piece spans the cut."""
        if len(s) > 2 and s[-2:] not in self.pairs:
            return self.part(s[:-1]) + self.merge(s[-1])
        return self.merge(s)

    def run_spaced(self, w: str) -> int:
        return self.run(SPACE + w)

    def part(self, s: str) -> int:
        if s[0] != SPACE:
            return self.bare[s]
        return self.spaced[s[1:]] if len(s) > 1 and s[1] != SPACE else self.run(s)

    def merge(self, s: str) -> int:
        """Initial symbols minus merges; a symbol without a piece counts as its bytes."""
        n = len(s) - merges(s, self.ranks.get)
        if not self.single.issuperset(s):
            n += sum(len(x.encode("utf-8", "replace")) - 1 for x in s if x not in self.single)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if not (self.cut_space and self.cut_line):
            return self.run(SPACE + text.replace(" ", SPACE))
        spaced, bare, n, first = self.spaced.__getitem__, self.bare.__getitem__, 0, True
        for line in text.split("\n"):
            words = line.split(" ")
            if "" in words:
                n += self.ragged((" " if first else "") + line)
            else:
                n += (spaced if first else bare)(words[0]) + sum(map(spaced, words[1:]))
            if not first:
                n += self.newline
            first = False
        return n

    def ragged(self, line: str) -> int:
        """A line with spaces side by side or at an end: each run of them stays with the word after it."""
        n, words, lead = 0, line.split(" "), 0
        if words[0]:
            n += self.bare[words[0]]
        for w in words[1:]:
            lead += 1
            if w:
                n += self.spaced[w] if lead == 1 else self.run(SPACE * lead + w)
                lead = 0
        return n + (self.run(SPACE * lead) if lead else 0)


@functools.lru_cache(maxsize=4)
def counter(model: str) -> PieceCounter:
    """One for each Python worker, kept between tasks."""
    return PieceCounter(model)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row (id, n_bytes, n_tokens, over_limit) for each document; one scan, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, count = batch.column(1).to_pylist(), counter(model).count
        n = [count(t) for t in texts]
        size = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(by_batch(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
