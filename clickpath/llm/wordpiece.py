"""Word-piece counts by the linear longest-match automaton.

A trie of the vocabulary whose nodes carry a failure link and how many pieces
the link pops. A word is read once, symbol by symbol; where no edge fits, the
pops are added and the link followed, so no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clickpath.llm.common import ddl, whole_text, widened

START, REST = 0, 1  # roots: the beginning of a word, the inside of a word
DEAD = -1


class Automaton:
    """Compiled from (piece, inside) pairs; ``inside`` pieces continue a word."""

    def __init__(self, pieces: Iterable[tuple[bytes, bool]]):
        self.edges: list[dict[int, int]] = [{}, {}]
        final = {START: False, REST: False}
        for piece, inside in pieces:
            node = REST if inside else START
            for symbol in piece:
                node = self.edges[node].setdefault(symbol, len(self.edges))
                if node == len(self.edges):
                    self.edges.append({})
                    final[node] = False
            final[node] = bool(piece) or final[node]
        self.link = [DEAD] * len(self.edges)
        self.pops = [0] * len(self.edges)
        level = [START, REST]
        while level:  # parents come before children
            following = []
            for parent in level:
                for symbol, node in self.edges[parent].items():
                    following.append(node)
                    if final[node]:
                        self.link[node], self.pops[node] = REST, 1
                        continue
                    back, popped = self.link[parent], self.pops[parent]
                    while back != DEAD and symbol not in self.edges[back]:
                        popped += self.pops[back]
                        back = self.link[back]
                    if back != DEAD:
                        self.link[node], self.pops[node] = self.edges[back][symbol], popped
            level = following

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match, or -1 if the word has none."""
        edges, link, pops = self.edges, self.link, self.pops
        node, total = START, 0
        for symbol in word:
            following = edges[node].get(symbol)
            while following is None:
                total += pops[node]
                node = link[node]
                if node == DEAD:
                    return -1
                following = edges[node].get(symbol)
            node = following
        while node > REST:  # the end: nothing more can be matched
            total += pops[node]
            node = link[node]
        return total if node == REST or not word else -1


def read_pieces(path: str, word_start: str = "Ġ") -> list[tuple[bytes, bool]]:
    """(piece, inside) of a byte-level vocabulary file, special tokens left out.

    Byte-level files write each byte as a printable character: those that are
    printable stand for themselves, the others for 256 and up in order.
    ``word_start`` is the sign of a piece that begins a word.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    pieces = []
    for piece in spec["model"]["vocab"]:
        if piece not in special and all(c in shown for c in piece):
            inside = not piece.startswith(word_start)
            body = piece if inside else piece[len(word_start):]
            if body:
                pieces.append((bytes(shown[c] for c in body), inside))
    return pieces


@lru_cache(maxsize=2)
def _compiled(pieces: tuple[tuple[bytes, bool], ...]) -> Automaton:
    return Automaton(pieces)


def token_counts(docs: DataFrame, pieces: list[tuple[bytes, bool]], keep: list[str],
                 max_word_bytes: int | None = None, remembered: int = 200_000) -> DataFrame:
    """``keep`` columns, n_words, n_tokens and n_unknown of each text.

    Words are split at ASCII white space; a word without pieces, or longer than
    ``max_word_bytes``, counts as one unknown token. A null text counts as
    empty: zeros. Repeated rows are counted each. The vocabulary is broadcast;
    it is fixed by its file and does not grow with the data. A task remembers
    the counts of up to ``remembered`` words and forgets all when it has more.
    """
    spark = SparkSession.getActiveSession() or docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(shared.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column("_counted").to_pylist():
                words = text.encode().split()
                tokens = unknown = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        too_long = max_word_bytes is not None and len(word) > max_word_bytes
                        n = -1 if too_long else automaton.count(word)
                        if len(known) >= remembered:
                            known.clear()
                        known[word] = n
                    if n < 0:
                        unknown += 1
                        tokens += 1
                    else:
                        tokens += n
                n_words.append(len(words))
                n_tokens.append(tokens)
                n_unknown.append(unknown)
            yield widened(batch, keep, {"n_words": n_words, "n_tokens": n_tokens, "n_unknown": n_unknown})

    return (docs.select(*keep, whole_text().alias("_counted"))
            .mapInArrow(run, f"{ddl(docs, keep)}, n_words long, n_tokens long, n_unknown long"))
