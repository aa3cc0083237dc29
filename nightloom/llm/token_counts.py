"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary becomes a trie.  Every node has a failure link and the number of pieces popped when it is followed, both
computed once, so a word's number of longest-match pieces comes from one pass over its characters; no piece is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import register, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Mark of a piece that begins a word.
BEGIN = "▁"
#: Words whose counts a task remembers.
MEMO = 200_000
ROOT, INNER, NOWHERE = 0, 1, -1


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of a vocabulary file, without its control and byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]


class Automaton:
    """Nodes are numbers; ROOT is where a word begins (its mark is read already), INNER where a later piece begins."""

    def __init__(self, pieces: list[str], begin: str = BEGIN):
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for piece in pieces:
            at, rest = (ROOT, piece[len(begin) :]) if piece.startswith(begin) else (INNER, piece)
            if at == INNER and not rest:
                continue
            for ch in rest:
                to = self.next[at].get(ch)
                if to is None:
                    to = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = to
            final[at] = True
        self.fail, self.pops = [NOWHERE] * len(final), [0] * len(final)
        if final[ROOT]:  # the mark alone is a piece
            self.fail[ROOT], self.pops[ROOT] = INNER, 1
        wave = [ROOT, INNER]
        while wave:
            later = []
            for at in wave:
                for ch, to in self.next[at].items():
                    if final[to]:
                        self.fail[to], self.pops[to] = INNER, 1
                    else:
                        z, popped = self.fail[at], self.pops[at]
                        while z != NOWHERE and ch not in self.next[z]:
                            popped += self.pops[z]
                            z = self.fail[z]
                        if z != NOWHERE:
                            self.fail[to], self.pops[to] = self.next[z][ch], popped
                    later.append(to)
            wave = later

    def count(self, word: str) -> int:
        """Pieces of one word; 0 if some rest of it has no piece."""
        at, popped = ROOT, 0
        for ch in word:
            to = self.next[at].get(ch)
            while to is None:
                popped += self.pops[at]
                at = self.fail[at]
                if at == NOWHERE:
                    return 0
                to = self.next[at].get(ch)
            at = to
        while at != INNER:
            popped += self.pops[at]
            at = self.fail[at]
            if at == NOWHERE:
                return 0
        return popped


def _count(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    automaton = Automaton(pieces.value)
    memo: dict[bytes, int] = {}
    for batch in batches:
        n_words, n_tokens, n_unknown = [], [], []
        for text in batch.column("text"):
            words = (text.as_py() or "").encode().split()
            total = unknown = 0
            for word in words:
                n = memo.get(word)
                if n is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    n = memo[word] = automaton.count(word.decode())
                total += n or 1
                unknown += not n
            n_words.append(len(words))
            n_tokens.append(total)
            n_unknown.append(unknown)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"]
        )


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each input row.

    Words are runs of other bytes than space and 9 to 13; a word that the pieces do not cover is one unknown token.
    Null and empty texts have 0 of each; texts and words of any length are read whole; repeated rows are counted each;
    other columns are ignored, whatever their names; an empty table gives no rows.  The vocabulary, a file of fixed
    size, is read by the driver and broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_count, pieces=pieces), "doc_id long, n_words long, n_tokens long, n_unknown long")


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
