"""Repeated passages of a corpus: the steps that word windows and byte strings share.

Windows of T symbols that occur twice anywhere have equal anchors (`arrays.window_anchors`). All windows with one anchor
form a cell. Only cells whose anchor occurs twice can hold a repeated window, and equal cells are counted before anything
is compared, so a large group of copies shrinks to one row. What is left, distinct cells that share an anchor, goes to
the operator's own method, which says which windows of each cell are repeated. Anchors with very many distinct cells are
counted window by window instead, so no task meets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODES, Powers, WordHashes, hashed, prefix, span_hash, window_anchors, words
from .store import keep, split_by_keys

HOT_CELLS = 2000         # distinct cells of an anchor that one task compares; more are counted window by window


def pack_place(first, anchor, last):
    """First window, distance of the anchor from it, and number of windows of a cell in one number; up to 256 windows."""
    return (first << 16) | ((anchor - first) << 8) | (last - first)


def unpack_place(place: int) -> tuple[int, int, int]:
    """(first window, distance of the anchor, windows)."""
    return place >> 16, place >> 8 & 0xFF, (place & 0xFF) + 1




class Words:
    """Texts as words `[^\\x20\\x09-\\x0D]+`; windows of 35 words."""
    length, k, name = 35, 10, "words"

    def __init__(self):
        self.cache, self.powers = WordHashes(), Powers()

    def units(self, text: str) -> list[bytes]:
        return words(text)

    def codes(self, units) -> np.ndarray:
        return hashed(units, self.cache)

    def pack(self, units) -> bytes:
        return b" ".join(units)

    def unpack(self, content: bytes) -> list[bytes]:
        return content.split(b" ")


class Bytes(Words):
    """Texts as UTF-8 bytes; strings of 200 bytes."""
    length, k, name = 200, 48, "bytes"

    def units(self, text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass") if text else b""

    def codes(self, units) -> np.ndarray:
        return BYTE_CODES[np.frombuffer(units, dtype=np.uint8)]

    def pack(self, units) -> bytes:
        return units

    def unpack(self, content: bytes) -> bytes:
        return content


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and _row, a hash of both. Rows equal in both share marks, and each counts as an occurrence."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))


def anchors(rows: DataFrame, kind: type[Words]) -> DataFrame:
    """(h, c, _row, place): anchor hash, cell hash, row and place of every cell."""
    def run(batches):
        own = kind()
        for pdf in batches:
            cols = []
            for row, text in zip(pdf["_row"].tolist(), pdf["text"]):
                first, last, anchor, h, c = window_anchors(own.codes(own.units(text)), own.length, own.k, own.powers)
                if len(h):
                    cols.append((h, c, np.full(len(h), row), pack_place(first, anchor, last)))
            if cols:
                yield pd.DataFrame(dict(zip(("h", "c", "_row", "place"), map(np.concatenate, zip(*cols)))))
    return rows.where(F.col("text").isNotNull()).select("_row", "text").mapInPandas(run, "h long, c long, _row long, place long")


def cell_contents(rows: DataFrame, wanted: DataFrame, kind: type[Words]) -> DataFrame:
    """(h, c, m, n_cells, offset of the anchor, windows, content) of wanted cells (h, c, m, n_cells, _row, place), cut out of their texts."""
    def run(batches):
        own = kind()
        for pdf in batches:
            out = []
            for text, cells in zip(pdf["text"], pdf["_cells"]):
                units = own.units(text)
                for w in cells:
                    first, offset, n = unpack_place(w["place"])
                    out.append((w["h"], w["c"], w["m"], w["n_cells"], offset, n, own.pack(units[first:first + n - 1 + own.length])))
            yield pd.DataFrame(out, columns=["h", "c", "m", "n_cells", "offset", "windows", "content"])
    by_row = wanted.groupBy("_row").agg(F.collect_list(F.struct("h", "c", "m", "n_cells", "place")).alias("_cells"))
    possible, _ = split_by_keys(rows.where(F.col("text").isNotNull()), "_row", wanted)
    one = possible.join(by_row, "_row")
    return one.select("text", "_cells").mapInPandas(run, "h long, c long, m long, n_cells long, offset int, windows int, content binary")


def hot_masks(cells: DataFrame, kind: type[Words]) -> DataFrame:
    """(h, c, mask) of cells of hot anchors: every window is a row, and equal windows are counted."""
    def windows(batches):
        own = kind()
        for pdf in batches:
            cols = []
            for h, c, m, n, content in zip(pdf["h"], pdf["c"], pdf["m"], pdf["windows"], pdf["content"]):
                p = prefix(own.codes(own.unpack(content)), own.powers)
                at = np.arange(n)
                cols.append((np.full(n, h), np.full(n, c), np.full(n, m), at, span_hash(p, at, at + own.length, own.powers).view(np.int64)))
            if cols:
                yield pd.DataFrame(dict(zip(("h", "c", "m", "at", "w"), map(np.concatenate, zip(*cols)))))

    def fold(pdf):
        mask = sum(1 << a for a in set(pdf["at"].tolist()))
        return pd.DataFrame({"h": [pdf["h"][0]], "c": [pdf["c"][0]], "mask": [mask.to_bytes((mask.bit_length() + 7) // 8, "little")]})
    rows = keep(cells.mapInPandas(windows, "h long, c long, m long, at int, w long"))
    twice = rows.groupBy("h", "w").agg(F.sum("m").alias("n")).where("n > 1").select("h", "w")
    return rows.join(twice, ["h", "w"], "left_semi").groupBy("h", "c").applyInPandas(fold, "h long, c long, mask binary")


def repeated_windows(rows: DataFrame, kind: type[Words], method: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_row, marks): for every row with repeated windows, structs of a cell's place and the mask of its repeated windows.

    `method` takes distinct cells that share anchors (h, c, m, offset, windows, content), m rows each, and returns (h, c, mask).
    A null mask in `marks` stands for all windows of the cell.
    """
    found = anchors(rows, kind)
    # written first, so that the join below has two plain shuffles and Spark can split a hot anchor's rows
    twice = keep(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    hits = keep(found.join(twice, "h", "left_semi"))
    cells = hits.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("_row", "place")).alias("rep"))
    per_anchor = cells.groupBy("h").agg(F.count(F.lit(1)).alias("n_cells"))
    wanted = keep(cells.join(per_anchor.where("n_cells > 1"), "h").select("h", "c", "m", "n_cells", "rep._row", "rep.place"))
    contents = keep(cell_contents(rows, wanted, kind))
    hot = F.col("n_cells") > HOT_CELLS
    masks = method(contents.where(~hot)).unionByName(hot_masks(contents.where(hot), kind))
    lone = wanted.where("m = 1").select("h", "c")
    # a cell that occurs twice is repeated as a whole; a lone one as its mask says
    some = hits.join(keep(masks).join(lone, ["h", "c"]), ["h", "c"]).select("_row", "place", "mask")
    whole = hits.join(lone, ["h", "c"], "left_anti").select("_row", "place", F.lit(None).cast("binary").alias("mask"))
    return some.unionByName(whole).groupBy("_row").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))


def covered(n: int, marks, length: int) -> np.ndarray:
    """True for the symbols of a text of n that a marked window covers."""
    step = np.zeros(n + 1, dtype=np.int64)
    for mark in marks if marks is not None else ():
        (first, _, count), mask = unpack_place(mark["place"]), mark["mask"]
        if mask is None:
            step[first] += 1
            step[first + count - 1 + length] -= 1
            continue
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(mask, dtype=np.uint8), bitorder="little"))
        np.add.at(step, first + bits, 1)
        np.add.at(step, first + bits + length, -1)
    return np.cumsum(step[:-1]) > 0


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with their `marks`; rows that surely have none are not shuffled."""
    marks = keep(marks)
    possible, rest = split_by_keys(rows, "_row", marks)
    return possible.join(marks, "_row", "left").unionByName(rest, allowMissingColumns=True)
