"""Quality rules: repetition coverage by rolling hashes.

Words are hashed once. The hashes of all n-grams of one length follow from
those one word shorter by a multiplication and an addition over the whole
array, so every length costs one numpy pass and one sort of the text's own
n-grams. Each length measures the characters of words that stand in a later
occurrence of an n-gram, lines those of later equal lines.

A text is independent of all others: no shuffle, and memory is bounded by a
batch of texts. A null text is an empty one; an empty text has no words and
fails the base rule. Equal rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyhouse.llm.common import id_type, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 8


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest share of characters a text may have in repeated parts.

    ``top``: n-gram length to the share of the most frequent n-gram.
    ``covered``: n-gram length to the share inside later occurrences.
    Fixed values: those published for the MassiveText corpus.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    lines: float = 0.20
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    covered: dict[int, float] = field(
        default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    )


def gram_hashes(words: np.ndarray, lengths: range) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n-gram at each place) for n = 1, 2, …"""
    grams = words
    for n in lengths:
        if n > 1:
            if len(grams) < 2:
                return
            grams = grams[:-1] * BASE + words[n - 1 :]
        yield n, grams


def repeated(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """Places of n-grams found twice or more, which of them are later
    occurrences, and the count and a place of the most frequent one."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return None
    again = np.concatenate(([False], same))
    several = again | np.concatenate((same, [False]))
    starts = np.flatnonzero(~again)
    counts = np.diff(np.append(starts, len(ranked)))
    most = int(counts.max())
    # of equally frequent n-grams, the one that begins first in the text
    first = int(order[starts[counts == most]].min())
    return order[several], order[again], most, first


def covered(places: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in an n-gram that begins at one of the places."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: str, limits: RepetitionLimits) -> dict:
    words = WORD.findall(text)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(map(len, WORD.findall(line)))
        elif WORD.search(line):
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    repeat_words, shares, failed = 0, {}, ""
    longest = max(WINDOW, *limits.top, *limits.covered)
    with np.errstate(over="ignore"):
        for n, grams in gram_hashes(hashes, range(1, longest + 1)):
            if n == 1:
                continue
            found = repeated(grams)
            if found is None:
                break  # no longer n-gram can repeat either
            several, later, most, place = found
            if n == WINDOW:
                repeat_words = int(covered(several, n, len(words)).sum())
            if n in limits.top:
                share = most * int(sizes[place : place + n].sum()) / total
                shares[f"top_{n}"] = (share, limits.top[n])
            if n in limits.covered:
                share = int(sizes[covered(later, n, len(words))].sum()) / total
                shares[f"covered_{n}"] = (share, limits.covered[n])
    if total:
        shares["lines"] = (dup_line_chars / total, limits.lines)
    failed = ",".join(sorted(name for name, (share, most) in shares.items() if share > most))
    base_failed = (
        len(words) < limits.min_words
        or 100 * repeat_words > limits.max_repeat_percent * len(words)
    )
    return {
        "n_words": len(words),
        "word_chars": total,
        "n_symbols": len(SYMBOL.findall(text)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": not base_failed and not failed,
        "dup_line_share": shares.get("lines", (0.0,))[0],
        "covered_share": max((s for k, (s, _) in shares.items() if k.startswith("c")), default=0.0),
        "failed_rules": failed,
    }


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, covered_share double, "
    "failed_rules string"
)


def repetition_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: RepetitionLimits = RepetitionLimits(),
) -> DataFrame:
    """One row per row of ``docs``: its counts, shares, failed rules and verdict."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([measure(t, limits) for t in batch["text"]], index=batch.index)
            if len(batch):
                found.insert(0, "doc_id", batch["doc_id"])
                yield found

    return texts(docs, id_col, text_col).mapInPandas(
        rows, f"doc_id {id_type(docs, id_col)}, {SCHEMA}"
    )
