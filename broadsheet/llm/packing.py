"""Packing: concatenate all documents and cut the stream into windows of equal length.

Two passes over partitions. The first tokenises every text once, writes the ids with each document's offset inside its
partition, and so knows the partitions' totals. A prefix sum over those totals (one row per partition) gives each
document its global offset, and the second pass cuts documents at multiples of the window. No ids are shuffled: a window
that spans two partitions gets boundary records from both, which agree on its number and their offsets in it.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they stand; a null
document id is kept as null; no rows give no pieces; other columns are ignored. Only the last window is not full.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, type_of
from broadsheet.session import cut

#: Distinct space-separated chunks whose ids a worker remembers.
REMEMBERED = 400_000
SPACE_RUN = re.compile(r"\s ")


class ByteBpe:
    """Ids of the byte-level BPE as tokenizers gives them, with a memory for chunks that come again.

    In this vocabulary's splitting rule a space that no white space precedes always starts a new piece, so a text whose
    spaces all stand like that is the concatenation of its chunks. Others are encoded whole, and texts that hold a
    special token's string go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        if SPACE_RUN.search(text):
            return np.array(self.encode(text), dtype="<u2").tobytes()
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = [np.array(self.encode(first), dtype="<u2").tobytes()]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = known[chunk] = np.array(self.encode(" " + chunk), dtype="<u2").tobytes()
            out.append(ids)
        return b"".join(out)


@functools.cache
def byte_bpe(json_path: str | None = None, ranks_path: str | None = None) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(
        json_path or public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def tokenised(docs: DataFrame, id_col: str, text_col: str, end_id: int, json_path: str | None, ranks_path: str | None) -> DataFrame:
    """doc_id, part, local_start, n, ids: one row per document, offsets counted within its partition."""

    def run(batches):
        encoder, part, at = byte_bpe(json_path, ranks_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            ids = [encoder.packed(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "local_start", "n", "ids"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"doc_id {type_of(docs, id_col)}, part int, local_start long, n long, ids binary")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    tokens = cut(tokenised(docs, id_col, text_col, end_id, json_path, ranks_path))
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            rows, ids_out = [], []
            for i, (base, local, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                at, n, start = base + local, len(ids) // 2, 0
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                while start < n:
                    offset = (at + start) % window
                    length = min(window - offset, n - start)
                    piece = wide[start : start + length]
                    rows.append(i)
                    out.append((start, length, zlib.crc32(piece.tobytes()), n, (at + start) // window, offset))
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    start += length
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    # one row per partition of the first pass, so its size is bounded by the number of tasks
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "base", "local_start", "ids")
    schema = f"doc_id {type_of(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(placed, run, schema + (", ids array<int>" if with_ids else ""))
