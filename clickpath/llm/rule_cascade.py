"""Quality rules run as a short-circuit cascade, cheapest rejection first."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickpath.llm.common import WORD, ddl, whole_text, widened, window_hashes

_WORD = re.compile(WORD)
# Fixed values
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


class Text:
    """The measures of one text, each worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        seen: dict[str, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.uint64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by a window of five words that occurs twice or more."""
        windows = window_hashes(self.word_ids, 5)
        if len(windows) < 2:
            return 0
        _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[place] > 1)
        edges = np.zeros(self.n_words + 1, np.int64)
        edges[starts] += 1
        edges[starts + 5] -= 1
        return int((np.cumsum(edges) > 0).sum())

    @cached_property
    def n_distinct_words(self) -> int:
        return int(self.word_ids.max()) + 1 if self.n_words else 0

    @cached_property
    def n_upper_words(self) -> int:
        return sum(len(w) > 1 and w.isupper() for w in self.words)

    @cached_property
    def n_letter_words(self) -> int:
        return sum(any(map(str.isalpha, w)) for w in self.words)


@dataclass(frozen=True)
class Rule:
    """Rejects a text; a rule reads measures, never other rules."""

    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    """Under 10 words, or over a fifth of the words in repeated windows."""
    return t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words


#: The rules besides the base; ratios are taken to the number of words or lines.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("few_distinct_words", lambda t: t.n_words >= 50 and 10 * t.n_distinct_words < t.n_words),
    Rule("capitals", lambda t: 2 * t.n_upper_words > t.n_words),
    Rule("no_letters", lambda t: 2 * t.n_letter_words < t.n_words),
)


def measured(docs: DataFrame, rules: Iterable[Rule] = RULES, sample_rows: int = 400) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) of each rule on a bounded sample.

    The sample (about ``sample_rows`` rows, drawn at random from all) only
    decides in which order the rules run. The verdict is the same in any order.
    """
    rules = tuple(rules)
    share = min(1.0, sample_rows / max(docs.count(), 1))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rule in rules:
                begin = time.perf_counter()
                hits = sum(rule.rejects(Text(text)) for text in batch["text"])
                yield pd.DataFrame({"rule": [rule.name], "seconds": [time.perf_counter() - begin],
                                    "hits": [hits], "seen": [len(batch)]})

    rows = (docs.select("text").sample(share, seed=1)
            .mapInPandas(probe, "rule string, seconds double, hits long, seen long")
            .groupBy("rule").agg(F.sum("seconds"), F.sum("hits"), F.sum("seen")).collect())
    return [(name, seconds / max(seen, 1), hits / max(seen, 1)) for name, seconds, hits, seen in rows]


def cascade(rules: Iterable[Rule], figures: Iterable[tuple[str, float, float]]) -> list[Rule]:
    """The rules by falling rejection per cost; unmeasured ones go last."""
    rank = {name: -share / max(seconds, 1e-9) for name, seconds, share in figures}
    return sorted(rules, key=lambda r: (rank.get(r.name, math.inf), r.name))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean"


def judge(docs: DataFrame, keep: list[str], rules: Iterable[Rule] = RULES, sample_rows: int = 400) -> DataFrame:
    """``keep`` columns of docs, the base measures and the verdict, a row per row.

    Reads column ``text``; a null text counts as empty and fails the base.
    Repeated rows are judged one by one, other columns are not looked at; one in
    ``keep`` that has the name of a measure gives way to the measure. Where
    the base fails no other rule runs, and the first rule that rejects ends the
    cascade.
    """
    order = cascade(rules, measured(docs, rules, sample_rows))
    names = [*MEASURES, "base_failed", "kept"]
    keep = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("_judged").to_pylist():
                t = Text(text)
                failed = base_failed(t)
                kept = not failed and not any(rule.rejects(t) for rule in order)
                rows.append((*(getattr(t, m) for m in MEASURES), failed, kept))
            yield widened(batch, keep, {name: [row[i] for row in rows] for i, name in enumerate(names)})

    return (docs.select(*keep, whole_text().alias("_judged"))
            .mapInArrow(run, f"{ddl(docs, keep)}, {SCHEMA}"))
