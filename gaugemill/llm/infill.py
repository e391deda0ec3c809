"""Fill-in-middle forms of texts, cut at line ranks that an indexable skip list looks up.

Level 0 of a text's list links its lines, each link with its widths in lines, code points and bytes. The nodes of a level
that also stand in the next one are drawn by a hash of their rank, one in four; an express link's widths are the sums of
those it passes over. A cut rank is found from the top: along a lane while the link's lines still fit into what is left of
the rank, then one level down. So both cuts come with their exact code points and bytes, whatever the text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The marks around the parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Parameters of the draws: the salt before an id, shares of a hundred that are transformed and that are suffix-first.
SALT, TRANSFORMED, SUFFIX_FIRST = 7, 100, 50
#: One node in FAN_OUT also stands in the next lane.
FAN_OUT = 4
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass
class Lane:
    """The links of one level: where each begins in the lane below, and its widths (lines, code points, bytes)."""

    below: np.ndarray
    widths: np.ndarray


class SkipList:
    """The lines of one text, ``[^\\n]*\\n`` or a rest without an end, indexable by rank."""

    def __init__(self, data: bytes):
        values = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(values == 10) + 1
        if len(values) and (not len(ends) or ends[-1] < len(values)):
            ends = np.append(ends, len(values))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
        chars = np.add.reduceat((values & 0xC0) != 0x80, starts, dtype=np.int64) if len(starts) else starts
        self.n = len(starts)
        self.lanes = [Lane(np.arange(self.n), np.stack([np.ones(self.n, np.int64), chars, ends - starts], 1))]
        ranks = np.arange(self.n, dtype=np.uint64)
        while len(self.lanes[-1].below) > FAN_OUT:
            low = self.lanes[-1]
            spread = (ranks * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) ^ ranks
            high = (spread * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(62) == 0
            high[0] = True  # the head stands in every lane
            begins = np.flatnonzero(high)
            if len(begins) == len(high):
                break
            self.lanes.append(Lane(begins, np.add.reduceat(low.widths, begins)))
            ranks = ranks[begins] * np.uint64(0xD1B54A32D192ED03) + np.uint64(len(self.lanes))

    def descend(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the line of this rank (0 to ``n``)."""
        left, chars, size, at = rank, 0, 0, 0
        for lane in reversed(self.lanes):
            while at < len(lane.below) and lane.widths[at, 0] <= left:
                lines, c, b = (int(w) for w in lane.widths[at])
                left, chars, size, at = left - lines, chars + c, size + b, at + 1
            if left == 0:
                break
            at = int(lane.below[at])
        return chars, size


def draws(key: str) -> list[int]:
    """Four even draws from an id: the first groups of eight hex digits of its salted digest."""
    digest = hashlib.sha256(f"{SALT}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(key: str, text: bytes, salted=draws) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and the output of one text."""
    lines = SkipList(text)
    h1, h2, h3, h4 = salted(key)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return lines.n, "plain", None, None, text
    first, last = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (c1, b1), (c2, b2) = lines.descend(first), lines.descend(last)
    prefix, middle, suffix = text[:b1], text[b1:b2], text[b2:]
    if h4 % 100 < SUFFIX_FIRST:
        return lines.n, "spm", c1, c2 - c1, b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return lines.n, "psm", c1, c2 - c1, b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from. Parts hold no mark, and a mark can't begin inside a part and
    end in the next mark, so the first of each kind is the one that was put in."""
    if form == "plain":
        return output
    second = PREFIX if form == "spm" else SUFFIX
    head = len(SUFFIX if form == "spm" else PREFIX)
    there = output.index(second, head)
    last = output.index(MIDDLE, there + len(second))
    one, other, middle = output[head:there], output[there + len(second) : last], output[last + len(MIDDLE) :]
    prefix, suffix = (other, one) if form == "spm" else (one, other)
    return prefix + middle + suffix


def _batches(with_output: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
        for batch in batches:
            row = batch.schema.get_field_index("row")
            keys, texts = batch.column("key"), batch.column("text").cast(pa.binary())
            out, begin, held = [], 0, 0
            digest = lambda x: hashlib.sha256(x).hexdigest()
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                n, form, before, inside, output = transform(keys[i].as_py() or "", text)
                out.append((n, form, before, inside, output if with_output else None, digest(output), digest(restore(output, form))))
                held += len(output) if with_output else 200
                if held > 1 << 25 or i == batch.num_rows - 1:
                    made = dict(zip(schema.names, zip(*out), strict=True))
                    columns = [pa.array(made[f.name], pa.binary()).cast(pa.string(), safe=False) if f.name == "output" else pa.array(made[f.name], f.type) for f in schema]
                    kept = [batch.column(row).slice(begin, i + 1 - begin)] if row >= 0 else []
                    yield pa.RecordBatch.from_arrays([*kept, *columns], ([batch.schema.names[row]] if row >= 0 else []) + schema.names)
                    out, begin, held = [], i + 1, 0

    return run


def fill_in_middle(documents: DataFrame, keep: list[str], output: bool = True) -> DataFrame:
    """Every row's number of lines, form, code points of prefix and middle, output, and the digests of the output and of
    the text rebuilt from it, beside ``keep``; without ``output`` that column is null, so no text leaves the task.

    A null text counts as empty; empty texts and those that hold a mark are plain. Draws hang on ``doc_id`` alone, a null
    id counting as the empty key, so repeated ids have equal draws and equal rows equal results. An empty table gives an
    empty one; kept columns that bear a result's name are left out. Nothing is shuffled; a task holds one batch and the
    lanes of one text, about eight integers a line.
    """
    names = [c for c in keep if c not in RESULTS]
    row = [F.struct(*map(F.col, names)).alias("row")] if names else []
    packed = documents.select(*row, F.col("doc_id").cast("string").alias("key"), "text")
    held = f"row {packed.schema['row'].dataType.simpleString()}, " if names else ""
    out = packed.mapInArrow(_batches(output), held + _SCHEMA)
    return out.select(*(["row.*"] if names else []), *RESULTS)
