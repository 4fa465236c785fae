"""Quality rules by distribution divergence.

Every language gets a reference from all of its documents: how its characters fall into classes, and how its words fall on
its commonest word bins (a word's bin is its hash modulo `BINS`, so the counts of any corpus fit a fixed table and merge
exactly). A document is compared with the references by Jensen-Shannon distance, and judged only where it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix64, runs, slices, span_hashes, utf8, words_of

BINS, COMMON = 4096, 40
SYMBOLS = b"#*$%&|<>"
#: Character classes: letters (lower case, or any beyond ASCII), capitals, digits, white space, full stops and commas, exclamation marks, other ASCII; UTF-8 continuation bytes have none.
CLASS = np.full(256, 6)
CLASS[[*range(97, 123)]] = 0
CLASS[128:192] = 7
CLASS[192:] = 0
CLASS[65:91], CLASS[48:58] = 1, 2
CLASS[[0x20, *range(9, 14)]] = 3
CLASS[[44, 46]], CLASS[33] = 4, 5
CLASSES = 7


def histograms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: characters by class; and of each word: its row, its bin, (last) the words of each row."""
    data, starts, ends, row, bounds = words_of(texts, lower=False)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    chars = np.zeros((len(texts), CLASSES + 1), np.int64)
    where = np.repeat(np.arange(len(texts)), np.diff(at))
    np.add.at(chars, (where, CLASS[data]), 1)
    chars[:, 3] -= 1  # the line feed after each text
    bins = (span_hashes(LOWER[data], starts, ends) % np.uint64(BINS)).astype(np.int64)
    return chars[:, :CLASSES], row, bins, np.diff(bounds)


def references(docs: DataFrame, least_words: int = 200) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(share of each character class, common bins, share of each common bin and of all others) of each lang.

    All documents count; a task sends what its rows add up to, at most BINS + CLASSES rows a language, and the driver gets
    the sums: as many rows a language, whatever the corpus. A row without lang counts in no reference; a language of under
    `least_words` words has none.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = utf8(b.column("text")), b.column("lang").to_pylist()
            for i, j in slices(texts):
                chars, row, bins, _ = histograms(texts[i:j])
                own = np.array([x or "" for x in langs[i:j]], object)
                for lang in set(own.tolist()) - {""}:
                    rows = np.flatnonzero(own == lang)
                    s = sums.setdefault(lang, np.zeros(BINS + CLASSES, np.int64))
                    s[:BINS] += np.bincount(bins[np.isin(row, rows)], minlength=BINS)
                    s[BINS:] += chars[rows].sum(axis=0)
        for lang, s in sums.items():
            k = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.int32()), pa.array(s[k], pa.int64())], ["lang", "bin", "n"])

    counts = docs.select("lang", "text").mapInArrow(step, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    tables: dict[str, np.ndarray] = {}
    for r in counts.collect():
        tables.setdefault(r["lang"], np.zeros(BINS + CLASSES))[r["bin"]] = r["n"]
    out = []
    for lang in sorted(tables):
        words, chars = tables[lang][:BINS], tables[lang][BINS:]
        if words.sum() >= least_words:
            common = np.argsort(-words, kind="stable")[:COMMON]
            share = words[common] / words.sum()
            out.append((chars / chars.sum(), common, np.append(share, 1 - share.sum())))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (0 to 1) of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def base_counts(texts: list[bytes], window: int = 3) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    data, starts, ends, row, bounds = words_of(texts)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    per_word = chars[ends] - chars[starts]
    word_chars = np.bincount(row, per_word, minlength=n).astype(np.int64)
    marks = np.concatenate(([0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))))
    n_symbols = marks[at[1:]] - marks[at[:-1]]
    h = span_hashes(data, starts, ends)
    line_starts, line_ends = runs(data != 10)
    own = np.searchsorted(at, line_starts, "right") - 1
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, own = line_starts[worded], line_ends[worded], own[worded]
    key = mix64(span_hashes(data, line_starts, line_ends) + own.astype(np.uint64))
    dup = np.ones(len(key), bool)
    dup[np.unique(key, return_index=True)[1]] = False
    n_dup = np.bincount(own[dup], minlength=n)
    repeat = np.zeros(len(h), bool)
    if len(h) >= window:
        first = np.arange(len(h) - window + 1)
        first = first[row[first] == row[first + window - 1]]
        key = row[first].astype(np.uint64)
        for k in range(window):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + h[first + k])
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = first[counts[which] > 1]
        for k in range(window):
            repeat[twice + k] = True
    return [np.diff(bounds), word_chars, n_symbols, n_dup, np.bincount(row[repeat], minlength=n)]


def judged(docs: DataFrame, refs: list, char_limit: float = 0.24, word_limit: float = 0.45, char_words: int = 30, word_words: int = 60, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (text and `extra` columns): the extra columns, the base counts, base_failed, kept, char_distance, word_distance.

    The distances are to the nearest reference (a wrong lang does not condemn a text); each counts only from its least
    number of words on. A null text has no words, so it fails; without any reference only the base rules judge.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for i, j in slices(texts):
                counts = base_counts(texts[i:j])
                chars, row, bins, n_words = histograms(texts[i:j])
                words = n_words.astype(float)
                total = np.maximum(chars.sum(axis=1), 1)[:, None]
                d_char = np.min([js_distance(chars / total, c) for c, _, _ in refs], axis=0) if refs else np.zeros(j - i)
                d_word = np.full(j - i, 1.0 if refs else 0.0)
                for _, common, share in refs:
                    to = np.full(BINS, len(common))
                    to[common] = np.arange(len(common))
                    own = np.bincount(row * (len(common) + 1) + to[bins], minlength=(j - i) * (len(common) + 1)).reshape(j - i, -1)
                    d_word = np.minimum(d_word, js_distance(own / np.maximum(words, 1)[:, None], share))
                failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
                far = (words >= char_words) & (d_char > char_limit) | (words >= word_words) & (d_word > word_limit)
                arrays = [b.column(c).slice(i, j - i) for c in extra] + [pa.array(c, pa.int64()) for c in counts]
                arrays += [pa.array(failed), pa.array(~failed & ~far), pa.array(d_char), pa.array(d_word)]
                yield pa.RecordBatch.from_arrays(arrays, [*extra, *names, "base_failed", "kept", "char_distance", "word_distance"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in extra] + [f"{n} long" for n in names] + ["base_failed boolean, kept boolean, char_distance double, word_distance double"])
    return docs.mapInArrow(step, schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, the base counts, base_failed, kept and the two distances; see judged()."""
    return judged(docs.select("doc_id", "text"), references(docs), extra=("doc_id",))
