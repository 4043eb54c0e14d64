"""Packing documents into token-budget batches over optimal length buckets.

Documents are encoded and cut into pieces of at most `max_len` tokens. The histogram of piece
lengths has at most max_len rows, whatever the input, and is the only thing the driver sees. A
dynamic program over it chooses up to `n_buckets` boundaries with the least total padding
when every piece is padded to the boundary above it. The inner minimum is over lines whose
slopes fall, so each bucket costs one pass over the histogram and the optimum is exact.
Inside a bucket, pieces are numbered over the whole cluster and every `budget // boundary`
of them make a batch. Numbering moves lengths and ids only; tokens are written once and join
their place at the end.

Nulls and edge cases: a null or empty text has no pieces and no row; rows with a null id
come first among equal lengths; repeated rows are packed one by one; equal lengths go by id,
then by place in the document, then by a hash of the tokens; an empty table gives an empty result; other columns are
carried only if named in keep, which may not name a column of the result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_keep, ranked, stash
from .token_counts import VOCABULARY, counter

MAX_LEN, BUDGET, N_BUCKETS = 2048, 65536, 12
#: Tokens of the pieces that a worker hands over at a time, about.
BLOCK = 1 << 18
PIECE = "doc_id", "piece", "start", "length", "tokens"
RESULT = (*PIECE, "bucket", "padded", "batch", "slot")


def boundaries(histogram: list[tuple[int, int]], n_buckets: int) -> list[int]:
    """histogram: (length, count), lengths distinct and positive. The upper ends of at most
    n_buckets buckets with the least padding; of equal choices the fewest buckets."""
    rows = sorted(histogram)
    if not rows:
        return []
    lengths, n, s = [r[0] for r in rows], [0], [0]
    for length, count in rows:
        n.append(n[-1] + count)
        s.append(s[-1] + length * count)
    d = len(rows)
    # cost of i..j in one bucket: lengths[j-1] * (n[j] - n[i]) - (s[j] - s[i])
    best = [lengths[j - 1] * n[j] - s[j] if j else 0 for j in range(d + 1)]
    froms, last = [[0] * (d + 1)], best[d]
    for _ in range(1, min(n_buckets, d)):
        lines: deque[tuple[int, int, int]] = deque()
        new, came = best[:], [0] * (d + 1)
        for j in range(1, d + 1):
            i = j - 1
            if i:
                slope, height = -n[i], best[i] + s[i]
                while len(lines) > 1 and (lines[-1][1] - lines[-2][1]) * (lines[-1][0] - slope) >= (height - lines[-1][1]) * (lines[-2][0] - lines[-1][0]):
                    lines.pop()
                lines.append((slope, height, i))
            x = lengths[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            if lines:
                value = lines[0][0] * x + lines[0][1] + x * n[j] - s[j]
                new[j], came[j] = value, lines[0][2]
        if new[d] >= last:
            break
        best, last = new, new[d]
        froms.append(came)
    out, j = [], d
    for came in reversed(froms):
        out.append(lengths[j - 1])
        j = came[j]
    return out[::-1]


def encoded(docs: DataFrame, text_col: str, vocabulary: str) -> DataFrame:
    """docs with each text as its tokens."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file: a fixed size

    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = counter(ranks.value).encode
        for batch in batches:
            texts, first, out, size = batch.column(text_col), 0, [], 0
            for i in range(batch.num_rows):
                out.append(np.array(encode(texts[i].as_py() or ""), np.int32))
                size += len(out[-1])
                if size > BLOCK or i == batch.num_rows - 1:
                    own, ends = batch.slice(first, len(out)), np.cumsum([0, *map(len, out)]).astype(np.int32)
                    tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
                    yield pa.RecordBatch.from_arrays([*[own.column(c) for c in others], tokens], [*others, "tokens"])
                    first, out, size = i + 1, [], 0

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "tokens array<int>"]))


def pieces(rows: DataFrame, max_len: int) -> DataFrame:
    """rows: doc_id, tokens and more. One row per piece of a document, with piece (from 0),
    start and length, and tokens its own."""
    n = F.size("tokens")
    others = [c for c in rows.columns if c not in ("doc_id", "tokens")]
    cut = rows.where(n > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / max_len).cast("long"))))
    start = F.col("piece") * max_len
    own = F.slice("tokens", (start + 1).cast("int"), F.lit(max_len))
    return cut.select("doc_id", "piece", start.alias("start"), own.alias("tokens"), *others).withColumn("length", F.size("tokens").cast("long"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, budget: int = BUDGET, n_buckets: int = N_BUCKETS, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, tokens array<int>, bucket (from 0),
    padded (the bucket's boundary), batch (from 0, within the bucket), slot (from 0), and keep."""
    if budget < max_len:
        raise ValueError("a batch must hold a piece of the greatest length")
    check_keep(keep, RESULT)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    cut = stash(pieces(encoded(rows, "text", vocabulary), max_len).withColumn("at", F.monotonically_increasing_id()), "pieces")
    histogram = cut.groupBy("length").count().collect()  # at most max_len rows
    ends = boundaries([(r["length"], r["count"]) for r in histogram], n_buckets)
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, end in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("length") <= end, F.lit(i)).otherwise(bucket)
        padded = F.when(F.col("length") <= end, F.lit(end).cast("long")).otherwise(padded)
    slim = cut.select("at", "doc_id", "piece", "length", F.xxhash64("tokens", *[f"c{i}" for i in range(len(keep))]).alias("h"), bucket.alias("bucket"), padded.alias("padded"))
    slim = ranked(slim, ["bucket"], ["length", "doc_id", "piece", "h", "at"], "n")
    room = F.floor(F.lit(budget) / F.col("padded")).cast("long")
    place = F.col("n") - 1
    slim = slim.select("at", "bucket", "padded", F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("slot"))
    return cut.join(slim, "at").select(*RESULT, *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])
