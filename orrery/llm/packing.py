"""Best-fit packing in bulk-synchronous rounds over runs of equal sizes.

Documents are sorted by size across the cluster: every piece gets its rank among those of its size.
A run is a range of ranks of one size, or a range of sequences with equal gaps.  A round takes the
largest size left.  Its pieces go to their successor, the tightest run of gaps that is large enough;
pieces that want the same gap are settled by rank, ``gap // size`` consecutive ranks a gap; the gaps
are updated and the sweep goes on to the next run, or opens sequences where no gap is left.  Rows
are not moved while runs are matched: in the end each finds its place by its size and rank.

A full gap keeps less than half of what it had, so a run is met at most log2(capacity) times, and a
size adds at most three runs: the steps of all rounds are bounded by the capacity (some 70,000 for
2048), whatever the number of rows.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

CAPACITY = 2048
#: Characters tokenized at once.
CHUNK_CHARS = 1 << 20


class ByteTokenizer:
    """Ids of a byte-level BPE tokenizer file.

    ``spec`` is the JSON that the ``tokenizers`` library reads; ids equal that library's with
    ``add_special_tokens=False``: the text of an added token becomes its one id.  The vocabulary is
    loaded into ``tiktoken``, which takes some fifth of the CPU.
    """

    #: The pattern of the byte-level pre-tokenizer, possessive where nothing can be given back, and Unicode's white space.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    #: White space at a stretch from which on it is encoded by itself, as the pattern's engine would run out of stack.
    LONG_BLANK = 10_000

    def __init__(self, spec: str):
        import re

        import tiktoken

        file = json.loads(spec)
        model, before = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or file["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is asked for")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take blanks or ask for word bounds are not supported")
        # Byte-level files write printable bytes as themselves and the others from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
        self.encode = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.blank = re.compile(f"[{self.BLANKS}]{{{self.LONG_BLANK},}}(?=[^{self.BLANKS}])").finditer
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else lambda t: [t]

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        parts = self.cut(text)
        if len(parts) == 1 and len(text) < self.LONG_BLANK:
            return array("I", self.encode(text)).tobytes()
        ids = array("I")
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.added[part])
                continue
            # All but the last blank before other characters are one unit, and so is what ends a text.
            at = 0
            for m in self.blank(part):
                ids.extend(self.encode(part[at : m.start()]))
                ids.extend(self.encode(part[m.start() : m.end() - 1]))
                at = m.end() - 1
            ids.extend(self.encode(part[at:]))
        return ids.tobytes()


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """(key, piece, start, length, ids) of whole texts; ``ids`` are little-endian unsigned 32-bit numbers.

    A document is its text's ids and then ``end_id``; a null text counts as empty.  Documents of
    more than ``capacity`` ids are cut into pieces of ``capacity``, the first of which takes the
    remainder.  Other columns are dropped; repeated rows stay repeated.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's file; executors get its content
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    fields = ["piece int", "start long", "length long", "ids binary"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = ByteTokenizer(spec.value), array("I", [end_id]).tobytes()
        width = 4 * capacity

        def one(keys: list, texts: list[str], shape: pa.DataType) -> pa.RecordBatch:
            rows = ([], [], [], [], [])
            for k, text in zip(keys, texts, strict=True):
                ids = encode(text) + last
                first = (len(ids) - 1) % width + 1
                at = 0
                for n, end in enumerate(range(first, len(ids) + 1, width)):
                    for col, v in zip(rows, (k, n, at // 4, (end - at) // 4, ids[at:end]), strict=True):
                        col.append(v)
                    at = end
            kinds = (shape, pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=[key, "piece", "start", "length", "ids"]
            )

        for batch in batches:
            keys, texts, held = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held > CHUNK_CHARS:
                    yield one(keys, texts, batch.column(0).type)
                    keys, texts, held = [], [], 0
            if keys:
                yield one(keys, texts, batch.column(0).type)

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(cut, ", ".join([f"`{key}` {kind}", *fields]))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts`` pieces of each size, run by run: (size, first rank, sequence, per, offset).

    From its first rank on, ``per`` consecutive pieces of the size fill each sequence from ``offset``
    on, the first one ``sequence`` and then its successors, up to the next step of that size.  Sizes
    are 1 to ``capacity``.
    """
    steps: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first sequence, how many)
    gaps: list[int] = []  # the gaps in order
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            per = gap // size
            full = min(n, left // per)
            steps.append((size, rank, first, per, capacity - gap))
            put(gap - per * size, first, full)
            rank, left = rank + full * per, left - full * per
            if left and full < n:  # the last ones share a gap that keeps room
                put(gap - left * size, first + full, 1)
                full, left = full + 1, 0
            put(gap, first + full, n - full)
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset``: best-fit packing into sequences of ``capacity``.

    Every row is one piece of ``length`` 0 to ``capacity`` (null or longer: an error).  Sequences
    are numbered from 0; offsets in a sequence start at 0 and leave no gaps.  Pieces of length 0 have
    sequences of their own, ``capacity`` pieces in each.  Pieces of equal length are placed in the
    order in which they come; repeated rows are pieces of their own.  Other columns pass through,
    whatever their names; columns with the two names are replaced; an empty table stays empty.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    size = F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(-1))
    size = F.when(size.between(0, capacity), size).otherwise(
        F.raise_error(F.concat(F.lit("piece length out of range: "), size.cast("string"))).cast("long")
    )
    # Numbered once and written, so that the numbers stay what they are.
    base = pieces.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), size.alias("size"))
    base = stage(base.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    part = F.shiftright("uid", 33).alias("part")  # the partition that wrote the row
    parts = stage(base.groupBy("size", part).agg(F.count(F.lit(1)).alias("n")), "pack-parts")
    # A row per size: at most as many as the capacity.
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    nothing = counts.pop(0, 0)
    steps = sorted(sweep(counts, capacity))
    opened = 1 + max((s[2] for s in steps), default=-1) + sum(counts.values()) if nothing else 0
    if nothing:
        steps.insert(0, (0, 0, opened, capacity, 0))
    table = np.array(steps, np.int64).reshape(-1, 5).T
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ranks, first, per, offset = shared.value
        keys = (sizes << 44) | ranks
        for batch in batches:
            size, rank = (np.asarray(batch.column(i)) for i in (1, 2))
            at = np.searchsorted(keys, (size << 44) | rank, "right") - 1
            turn, slot = np.divmod(rank - ranks[at], per[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first[at] + turn), pa.array(offset[at] + slot * size)], names=["row", "sequence_id", "offset"]
            )

    before = F.sum("n").over(W.partitionBy("size").orderBy("part")) - F.col("n")
    within = F.row_number().over(W.partitionBy("size", "part").orderBy("uid")) - 1
    ranked = base.withColumn("part", part).withColumn("rank", within)
    ranked = ranked.join(parts.select("size", "part", before.alias("before")), ["size", "part"])
    shape = T.StructType([base.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.select("row", "size", (F.col("rank") + F.col("before")).alias("rank")).mapInArrow(place, shape)
    return placed.select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence's pieces, joined in order of offset.  A sequence is bounded by the capacity."""
    at = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(at.alias("parts")).select("sequence_id", joined.alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Packed pieces of ``docs`` with the CRC-32 of their ids in place of the ids."""
    pieces = tokenize_pieces(docs, tokenizer_path or default_tokenizer())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
