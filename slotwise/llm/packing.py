"""Best-fit packing of token sequences with a bounded number of open bins.

Defined results: a null or empty text is a document of the single end id 0; repeated document rows are packed as often
as they occur; an empty table gives no rows; other columns of `documents` are never read.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import emit, extend
from .store import keep, table

LENGTH = 2048            # tokens of a sequence
OPEN_BINS = 512          # sequences a task keeps open
RUN = 500                # length of a run of characters from which a text goes through tokenizers
END_ID = b"\0\0\0\0"     # the id that ends a document, little-endian


class Ids:
    """Token ids of texts as little-endian bytes.

    The vocabulary comes in two forms. Its rank file gives the same ids as the tokenizers file for texts of ASCII and
    Latin letters without the special string, and is several times faster; all other texts go through tokenizers itself,
    and so do texts with long runs without or of white space, which the fast way's pattern matcher cannot hold.
    """

    def __init__(self, path: str):
        import base64
        import re
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u017e\\u2018-\\u201f]|<\\|endoftext")

    @staticmethod
    def long_runs(text: str) -> bool:
        """Whether a text may have a run of RUN characters of one kind; never wrongly false."""
        sizes = list(map(len, text.split()))
        return max(sizes, default=0) >= RUN or len(text) - sum(sizes) - len(sizes) >= RUN

    def __call__(self, text: str) -> bytes:
        if self.other.search(text) or self.long_runs(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


class BestFit:
    """Online best fit over a fixed number of open bins.

    Bit f of `free` is set while some open bin has exactly f free tokens, so the tightest bin for a piece of length n is
    the lowest set bit at n or above. A new bin beyond the limit closes the fullest open bin first.
    """

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.free, self.count, self.made = length, limit, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, f: int) -> int:
        stack = self.bins[f]
        b = stack.pop()
        if not stack:
            self.free &= ~(1 << f)
        self.count -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of a piece of n tokens."""
        above = self.free >> n
        if above:
            f = n + (above & -above).bit_length() - 1
            b = self._take(f)
        else:
            if self.count >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            b, f = self.made, self.length
            self.made += 1
        left = f - n
        if left:
            self.bins[left].append(b)
            self.free |= 1 << left
            self.count += 1
        return b, self.length - f


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Pieces (doc_id, copy, piece, start, length, ids_crc32, sequence_id).

    `copy` numbers the rows of a task, to tell repeated documents apart. A piece of full length is a sequence of its own
    and gets a negative sequence_id here; the others have none yet.
    """
    def make():
        ids_of = Ids(tokenizer)
        base, rows, full = TaskContext.get().partitionId() << 40, count(), count(1)

        def one(doc, text):
            ids = (ids_of(text) if text else b"") + END_ID
            n, row = len(ids) >> 2, base + next(rows)
            at, end, piece = 0, (len(ids) >> 2) % length or length, 0
            while at < n:
                yield doc, row, piece, at, end - at, zlib.crc32(ids[4 * at:4 * end]), -base - next(full) if end - at == length else None
                at, end, piece = end, end + length, piece + 1
        return one
    return emit(docs.select("doc_id", "text"), make, "doc_id long, copy long, piece int, start long, length long, ids_crc32 long, sequence_id long")


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset. Full pieces are sequences of their own; the others are packed per partition.

    Rows reach a partition by hash and are sorted there, so a task that is run again packs alike. Partitions are sized by
    Spark from the bytes they hold; each wastes at most its open bins at the end.
    """
    def make():
        fit, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 40

        def one(n):
            b, offset = fit.place(n)
            return base + b, offset
        return one
    todo = pieces.where(F.col("sequence_id").isNull()).drop("sequence_id").repartition("copy", "piece").sortWithinPartitions("copy", "piece")
    rest = extend(todo, make, "length", "sequence_id long, offset long")
    return rest.unionByName(pieces.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.lit(0).cast("long")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    pieces = keep(token_pieces(docs, tokenizer or tokenizer_path()))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
