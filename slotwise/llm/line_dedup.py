"""Line dedup with content-defined chunks of lines.

A boundary lies before a line when the rolling hash of the line and the one before it says so; a shift of the text moves
no boundary. Chunks of two or more lines that occur more than once anywhere are removed but for the first occurrence, in
the order of doc_id and place, after their bytes were compared with those of the first.

Defined results: a null text stays null and gives no chunks; an empty text is one empty line; rows equal in doc_id and
text are one document and share its result; a null doc_id comes before all others; an empty table gives no rows; other
columns pass through untouched, and names of the helper columns start with an underscore.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix
from .batches import emit, extend
from .store import keep, split_by_keys, table

DIVISOR = 3              # a boundary before every third line on average
MIN_LINES = 2            # shorter chunks are never removed


def line_chunks(text: str, divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """Chunks (first line, end line) of a text."""
    lines = text.split("\n")
    h = np.fromiter((xxhash.xxh64_intdigest(l.encode("utf-8", "surrogatepass")) for l in lines), dtype=np.uint64, count=len(lines))
    roll = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    cuts = [0, *(np.flatnonzero(roll % np.uint64(divisor) == 0) + 1).tolist(), len(lines)]
    return list(zip(cuts[:-1], cuts[1:]))


def long_chunks(text: str, divisor: int):
    """(number, first line, end line, bytes) of the chunks that may be removed."""
    lines = text.split("\n")
    for k, (lo, hi) in enumerate(line_chunks(text, divisor)):
        if hi - lo >= MIN_LINES:
            yield k, lo, hi, "\n".join(lines[lo:hi]).encode("utf-8", "surrogatepass")


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """`docs` with text shortened, and columns _lines, _removed (lines), _chunks (removed)."""
    keyed = docs.withColumn("_key", F.xxhash64("text"))

    def chunk():
        return lambda doc, key, text: ((doc, key, k, xxhash.xxh64_intdigest(b) - (1 << 63)) for k, _, _, b in long_chunks(text, divisor))
    slim = keyed.select("doc_id", "_key", "text").where(F.col("text").isNotNull())
    rows = keep(emit(slim, chunk, "doc_id long, _key long, _k int, _h long").distinct())
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_key", "_k")
    repeated = keep(rows.groupBy("_h").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_h", "_first"))

    def fetch():
        def one(text, wanted):
            want = {w["_k"]: w["_h"] for w in wanted}
            return ((want[k], b) for k, _, _, b in long_chunks(text, divisor) if k in want)
        return one
    owners = keep(repeated.select("_h", "_first.doc_id", "_first._key", "_first._k").groupBy("doc_id", "_key").agg(F.collect_list(F.struct("_h", "_k")).alias("_wanted")))
    one = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_key"] == b["_key"])
    possible, _ = split_by_keys(slim, "_key", owners)
    firsts = emit(possible.join(owners, one(possible, owners)).select("text", "_wanted"), fetch, "_h long, _bytes binary").dropDuplicates(["_h"])
    later = keep(rows.join(repeated, "_h").where(place != F.col("_first")).join(firsts, "_h")
                 .groupBy("doc_id", "_key").agg(F.collect_list(F.struct("_k", "_bytes")).alias("_later")))
    def cut():
        def one(text, later_ones):
            if text is None:
                return None, 0, 0, 0
            lines, gone = text.split("\n"), []
            if later_ones:
                known = {x["_k"]: x["_bytes"] for x in later_ones}
                gone = [(lo, hi) for k, lo, hi, b in long_chunks(text, divisor) if known.get(k) == b]
            kept, at = [], 0
            for lo, hi in gone:
                kept += lines[at:lo]
                at = hi
            kept += lines[at:]
            return "\n".join(kept), len(lines), len(lines) - len(kept), len(gone)
        return one
    possible, rest = split_by_keys(keyed, "_key", later)
    joined = possible.join(later, one(possible, later), "left").select(*[possible[f"`{c}`"] for c in docs.columns], later["_later"])
    joined = joined.unionByName(rest.select(*docs.columns), allowMissingColumns=True)
    out = extend(joined, cut, ["text", "_later"], "_text string, _lines int, _removed int, _chunks int", drop=("text", "_later"))
    return out.withColumnRenamed("_text", "text").select(*[F.col(f"`{c}`") for c in docs.columns], "_lines", "_removed", "_chunks")


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_chunks").alias("n_chunks"), F.sha2("text", 256).alias("kept_sha256"))
