"""Sentences and windows with exact offsets (TX16, TX17), as Arrow functions: greedy folds have no built-in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Marks that end a sentence, and what may close after them.
_END = re.compile(r"[.!?。！？।॥]+[\"'”’)\]}»]*(?=\s|$)|\n+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence without outer white space; a mark before white space, or a line end, closes one."""
    return [(e - len(text[s:e].lstrip()), s + len(text[s:e].rstrip())) for s, e in _spans(text)]


def _spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence with the white space before it; white space alone is no sentence."""
    ends = [m.end() for m in _END.finditer(text)]
    return [(s, e) for s, e in zip([0, *ends], [*ends, len(text)], strict=True) if text[s:e].strip()]


def _pieces(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """A sentence that is too long, split at the last blank within the limit, or at the limit."""
    while start < end:
        stop = min(end, start + most)
        if stop < end:
            blank = text.rfind(" ", start + 1, stop + 1)
            stop = blank if blank > start else stop
        yield start, stop
        start = stop


def windows(text: str, most: int) -> list[tuple[int, int, int, int, bool, str | None]]:
    """(start, end, sentence start, sentence end, aligned, reason): sentences packed greedily, never over ``most``.

    The sentence offsets are those of the whole sentences a window comes from. Every piece of a sentence that is too
    long is a window of its own, not aligned; packing starts afresh after it.
    """
    out: list[tuple[int, int, int, int, bool, str | None]] = []
    for s, e in _spans(text):
        if e - s > most:
            out += [(a, b, s, e, False, "oversized_sentence") for a, b in _pieces(text, s, e, most)]
        elif out and out[-1][4] and e - out[-1][0] <= most:
            out[-1] = (out[-1][0], e, out[-1][0], e, True, None)
        else:
            out.append((s, e, s, e, True, None))
    return out


def window_table(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """key, chunk_index, text, span_start, span_end, sentence_start, sentence_end, sentence_aligned, split_reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "chunk_index", "text", "span_start", "span_end", "sentence_start", "sentence_end", "sentence_aligned", "split_reason"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        for b in batches:
            rows = [(k, i, t[w[0] : w[1]], *w) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, w in enumerate(windows(t or "", most))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    schema = "key string, chunk_index int, text string, span_start int, span_end int, sentence_start int, sentence_end int, sentence_aligned boolean, split_reason string"
    return df.selectExpr(f"cast({key} as string) as key", f"{text} as text").mapInArrow(run, schema)
