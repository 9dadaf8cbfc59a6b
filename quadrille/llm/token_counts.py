"""Token counts of a unigram tokenizer by count-only Viterbi.

The vocabulary is that of a SentencePiece model file, with its scores. Blanks become the mark U+2581, which begins each
piece of text; a text's first piece gets one if it has none. Within a piece, an Aho-Corasick automaton enumerates all
vocabulary matches in one scan, and dynamic programming over character places carries the best score and, with it, the
number of tokens and of unknown characters, never the tokens themselves. Ties go as in the tokenizers library's Unigram
model: of equally good ways to reach a place, the one whose last token begins first stays. A character without a token of
its own may be unknown, at the least score minus 10, and counts as its UTF-8 bytes (byte fallback).

Null and empty texts have 0 tokens. Repeated rows are counted each on its own; a column named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import take_over

MARK = "▁"
#: Fixed value: what an unknown character costs beyond the least score.
UNKNOWN_PENALTY = 10.0
#: Distinct pieces of text a worker remembers; when full, it starts anew. It bounds memory, not what is counted.
CACHE_PIECES = 1_000_000
#: Characters of a piece that is not remembered.
LONG_PIECE = 200


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], limit: int = CACHE_PIECES):
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.limit = limit
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece of text."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = bytearray(n)
        for end, (size, score) in self.machine.iter(text):
            ends[end + 1].append((end + 1 - size, score))
            if size == 1:
                single[end] = 1
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            top, last = None, -1
            # Matches come longest first, so they begin in ascending order; a later one must be strictly better.
            for start, score in ends[e]:
                if top is None or best[start] + score > top:
                    top, last = best[start] + score, start
            tokens = count[last] + 1 if top is not None else 0
            if not single[e - 1] and (top is None or best[e - 1] + self.unknown > top):
                top, tokens = best[e - 1] + self.unknown, count[e - 1] + len(text[e - 1].encode())
            best[e], count[e] = top, tokens
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.replace(MARK, " ").split(" ")
        if len(parts) > 1 and not parts[0]:
            del parts[0]
        known = self.known
        found = list(map(known.get, parts))
        if None in found:
            if len(known) > self.limit:
                known.clear()
            for p in parts:
                if p not in known and len(p) <= LONG_PIECE:
                    known[p] = self.piece(MARK + p)
            return sum(known[p] if len(p) <= LONG_PIECE else self.piece(MARK + p) for p in parts)
        return sum(found)


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def counted(documents: DataFrame, model: str, *, text: str = "text", result: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """The documents with their number of tokens; model: path of the vocabulary on every executor."""
    documents = documents.drop(result)
    at = documents.columns.index(text)
    kept = [i for i in range(len(documents.columns)) if keep_text or i != at]
    names = [documents.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        take_over("token_counts", counter.known.clear)
        for batch in batches:
            n = pa.array([counter.count(x.as_py()) for x in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), n], [*names, result])

    schema = ", ".join([*(f"`{documents.schema[i].name}` {documents.schema[i].dataType.simpleString()}" for i in kept), f"`{result}` long"])
    return documents.mapInArrow(run, schema)
