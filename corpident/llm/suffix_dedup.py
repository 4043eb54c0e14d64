"""Removal of long byte strings that an earlier document also holds, by a sparse suffix array.

Which suffixes are sorted. Every window of `width` bytes is represented by one anchor in it:
the start of the k-gram of least hash, the leftmost of equals. The choice depends on the
window alone, so equal windows have their anchor at the same offset, and it is enough to
sort the suffixes that start at anchors (about one byte in fourteen), each with the bytes to
its left that its windows reach. Windows of an anchor are consecutive, so an anchor stands
for them by its context and a range of offsets.

1. Documents are dealt into groups by their id; all later steps use that one exchange.
2. Each group sends the distinct 47-bit fingerprints of its anchors' k-grams. Fingerprints
   that only one document has end there: no window over them can repeat. Collisions only
   cost time.
3. Remaining anchors are first compared within the group, where identical contexts collapse
   to their smallest document. What is left goes to buckets: splitters sampled from anchors'
   k-grams range-partition suffixes by their leading bytes. A bucket sorts by multikey
   quicksort, takes the common prefixes of neighbours, and finds for each offset the smallest
   document among equal windows. Splitters are whole k-grams and compared as such, so a run
   of equal leading bytes never straddles a boundary and the comparison across boundaries is
   void. There are at most N_RANGES ranges; beyond that, ranges are dealt over several
   buckets by a hash of the k-gram, which keeps equal ones together. Runs that would be too
   long for a bucket (k-grams seen in many groups) are cut up: their whole windows are dealt
   by a hash and then compared byte by byte.
4. Each group gets its anchors' answers back and cuts its documents.

Nulls and edge cases: a null text is empty; rows with a null id count as later than all ids;
rows of equal id never cut each other; equal strings inside one document stay; repeated rows
stay and are cut alike; an empty table gives an empty result; other columns are carried by
cut_texts, whatever their names, and by cut only if named in keep, which may not name a
column of the result. Rows equal in id and text are read by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_keep, partitions

#: Length of the k-grams that are hashed for anchors, in bytes.
K = 24
#: Bytes hashed at a time, about.
BLOCK = 1 << 18
#: Text bytes in a group and in a bucket, about.
GROUP_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: k-grams seen in this many groups have their windows dealt one by one.
HOT_GROUPS = 1024
#: Ranges that splitters make, at most.
N_RANGES = 4096
#: The splitters come from up to so many documents and anchors of each.
SAMPLE_DOCS, SAMPLE_ANCHORS = 2000, 64
LAST_ID = np.iinfo(np.int64).max

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S = [np.uint64(x) for x in (0, 8, 16, 24, 32, 29)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S[4])
    h *= _M[3]
    h ^= h >> _S[5]
    return h


def kgram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hashes of the K bytes from each place."""
    n = len(buf) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a = buf.astype(np.uint64)
    for s in (1, 2, 4):
        a = a[:-s] | (a[s:] << np.uint64(8 * s))
    h = a[:n] * _M[0]
    h ^= h >> _S[5]
    h += a[8 : n + 8]
    h *= _M[1]
    h ^= h >> _S[4]
    h += a[16 : n + 16]
    h *= _M[2]
    return _mix(h)


def _anchors(buf: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows at valid places: place, its hash, and its least and largest offset."""
    h = kgram_hashes(buf)
    n, span = len(buf) - width + 1, width - K + 1
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < span:
        m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
    s = np.flatnonzero(valid[:n])
    at = (m[s] & low).astype(np.int64)
    if not len(s):
        return at, h[:0], at, at
    # a new anchor, or the same place again after a gap (another document)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1))))
    last = np.append(first[1:], len(s)) - 1
    return at[first], h[at[first]], at[first] - s[last], at[first] - s[first]


class Group:
    """The documents of a group in one buffer, and their anchors in order."""

    def __init__(self, texts: list[bytes | None], ids: np.ndarray, width: int):
        self.width, self.ids = width, ids
        lengths = np.array([len(t) if t is not None else 0 for t in texts], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths
        self.buf = buf = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
        parts, at, n = [], 0, len(buf)
        while at + width <= n:
            stop = min(n, at + BLOCK + width - 1)
            doc = np.searchsorted(self.ends, np.array([at, stop - 1]), "right")
            near = slice(doc[0], doc[1] + 1)
            left = np.repeat(self.ends[near], np.minimum(self.ends[near], stop) - np.maximum(self.starts[near], at))
            valid = left - np.arange(at, stop) >= width
            p = _anchors(buf[at:stop], valid, width)
            parts.append((p[0] + at, *p[1:]))
            at += BLOCK
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.at, self.hash, self.low, self.high = (np.concatenate([e, *x]) for e, x in zip(empty, zip(*parts) if parts else [()] * 4))
        self.doc = np.searchsorted(self.ends, self.at, "right")
        self.prints = _mix(self.hash * _M[0]) >> np.uint64(17)


def _pack6(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _deal(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, its rows) for each bucket in key."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [(int(key[i[0]]), i) for i in np.split(order, cuts)] if len(key) else []


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes, row: int, *kinds: str) -> list[np.ndarray]:
    """The arrays of _squeeze; row: bytes of one row in all of them. A kind may be 'u1:76' for rows of 76."""
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n, at, out = size // row, 0, []
    for kind in kinds:
        kind, _, wide = kind.partition(":")
        a = np.frombuffer(raw, kind, n * int(wide or 1), at)
        out.append(a.reshape(n, -1) if wide else a)
        at += a.nbytes
    return out


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of words, read from left to right: three-way partition by the word at
    the current depth, and one word deeper only among equals. Small parts go by columns."""
    n, depth = words.shape
    out = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        a, b, d = todo.pop()
        if d >= depth or b - a < 2:
            continue
        rows = out[a:b]
        if b - a <= 4096:
            out[a:b] = rows[np.lexsort([words[rows, c] for c in range(depth - 1, d - 1, -1)])]
            continue
        key = words[rows, d]
        pivot = np.partition(key[:: max(1, len(key) // 101)], len(key[:: max(1, len(key) // 101)]) // 2)[len(key[:: max(1, len(key) // 101)]) // 2]
        less, same = key < pivot, key == pivot
        out[a:b] = np.concatenate([rows[less], rows[same], rows[~less & ~same]])
        x = a + int(less.sum())
        y = x + int(same.sum())
        todo += [(a, x, d), (x, y, d + 1), (y, b, d)]
    return out


def _sorted_prefixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the byte rows of text, and for each but the first the prefix shared with the one before."""
    n, w = text.shape
    order = multikey_quicksort(_words(text))
    shared = np.zeros(max(n - 1, 0), np.int64)
    for i in range(0, n - 1, 1 << 16):
        rows = text[order[i : i + (1 << 16) + 1]]
        other = rows[1:] != rows[:-1]
        shared[i : i + len(other)] = np.where(other.any(axis=1), other.argmax(axis=1), w)
    return order, shared


def _earlier(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row of equal key has a smaller doc."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    head = np.concatenate(([True], k[1:] != k[:-1]))
    least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    out = np.zeros(len(key), bool)
    out[order] = d > least
    return out


def resolve(text: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each anchor context (`width`-K bytes before the anchor, `width` from it on) a mask:
    bit o is set if its window at offset o is also one of a smaller doc."""
    n, span = len(doc), width - K
    mask = np.zeros(n, np.uint32)
    if n < 2:
        return mask
    right, shared_r = _sorted_prefixes(text[:, span:])
    left, shared_l = _sorted_prefixes(np.ascontiguousarray(text[:, :span][:, ::-1]))
    gr, gl = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(span + 1):
        i = np.flatnonzero((low <= o) & (o <= high))
        if len(i) < 2:
            continue
        gr[right] = np.concatenate(([0], np.cumsum(shared_r < width - o)))
        gl[left] = np.concatenate(([0], np.cumsum(shared_l < o)))
        mask[i[_earlier(gr[i] * n + gl[i], doc[i])]] |= np.uint32(1 << o)
    return mask


def _contexts(g: Group, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes around anchors i that their windows hold; zero beyond them."""
    span = g.width - K
    reach = np.arange(-span, g.width)
    out = np.zeros((len(i), span + g.width), np.uint8)
    for k in range(0, len(i), 1 << 14):
        s = slice(k, k + (1 << 14))
        own = (reach >= -high[s, None]) & (reach < g.width - low[s, None])
        place = np.where(own, g.at[i[s], None] + reach, 0)
        out[s] = np.where(own, g.buf[place], 0)
    return out


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian words, zeros after them."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64 bits of each row of bytes."""
    h = np.full(len(rows), _M[0])
    for word in _words(rows).T:
        h = (h ^ word) * _M[2]
        h ^= h >> _S[4]
    return _mix(h)


def _equal_rows(rows: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, the same for rows that are equal in all of them."""
    words = _words(rows)
    order = multikey_quicksort(words)
    new = np.zeros(len(rows), np.int64)
    if len(rows):
        new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    out = np.zeros(len(rows), np.int64)
    out[order] = np.cumsum(new)
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"g": pa.int64(), "b": pa.int64(), "kind": pa.int32(), "blob": pa.binary(), "kgram": pa.binary()}
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.table({n: pa.array(c, kinds[n]) for n, c in zip(names, columns)})


def _spare(table: pa.Table) -> pa.Table:
    """The table, once memory that is not in use has gone back."""
    pa.default_memory_pool().release_unused()
    return table


def _load(table: pa.Table, width: int) -> tuple[Group, pa.Table]:
    """A group and its rows, by id and then text: rows come in any order, and anchors are
    known by their number in the group."""
    ids = table.column("id").fill_null(LAST_ID).to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b"")))
    table = table.take(pa.array(order))
    return Group([x.as_py() for x in table.column("text")], ids[order], width), table


def _repeats(g: Group) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of a group, and which of them two of its ids have."""
    prints, inverse = np.unique(g.prints, return_inverse=True)
    ids = g.ids[g.doc]
    least, most = np.full(len(prints), LAST_ID), np.full(len(prints), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, ids)
    np.maximum.at(most, inverse, ids)
    return prints, least < most


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per document: doc_id long, n_bytes long, spans array<struct<start long, stop long>>
    (maximal removed runs, in bytes), kept binary (the other bytes), and the columns of keep.
    With as_text, kept is a string that loses whole characters only, null where the text is."""
    check_keep(keep, ("doc_id", "n_bytes", "spans", "kept"))
    if not K < width <= K + 31:
        raise ValueError(f"width must lie in {K + 1}..{K + 31}")
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    n_docs, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = partitions(spark)
    n_groups, n_buckets = max(1, -(-n_bytes // GROUP_BYTES)), max(1, min(parts, n_docs), -(-n_bytes // BUCKET_BYTES))
    splitters = _splitters(rows, n_docs, min(n_buckets, N_RANGES), width)
    per_range = -(-n_buckets // N_RANGES)
    n_buckets = per_range * min(n_buckets, N_RANGES)
    # by the text too, so that rows of one id, or none, do not all meet
    group = F.pmod(F.xxhash64("id", "text"), F.lit(n_groups)).alias("g")
    dealt = rows.select(group, "*").repartition(parts, "g")
    span = width - K
    context = span + width

    def send_prints(table: pa.Table) -> pa.Table:
        g, _ = _load(table, width)
        prints, multi = _repeats(g)
        own = table.column("g")[0].as_py()
        coded = (prints << np.uint64(1)) | multi.astype(np.uint64)
        bucket = (prints % np.uint64(n_buckets)).astype(np.int64)
        return _spare(_table([(own, b, _pack6(coded[i])) for b, i in _deal(bucket)], ["g", "b", "blob"]))

    def count_prints(table: pa.Table) -> pa.Table:
        groups = table.column("g").to_numpy()
        blobs = [_unpack6(x.as_py()) for x in table.column("blob")]
        coded, of = np.concatenate(blobs), np.repeat(groups, [len(x) for x in blobs])
        prints, multi = coded >> np.uint64(1), coded & np.uint64(1)
        _, inverse, n = np.unique(prints, return_inverse=True, return_counts=True)
        hot = n[inverse] >= HOT_GROUPS
        told = ((n[inverse] > 1) & (multi == 0)) | hot | (np.bincount(inverse, multi)[inverse] > multi)
        i = np.flatnonzero(told)
        coded = (prints[i] << np.uint64(1)) | hot[i].astype(np.uint64)
        return _spare(_table([(g, _pack6(coded[j])) for g, j in _deal(of[i])], ["g", "blob"]))

    def send_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], ["g", "b", "kind", "blob"])
        own, (g, _) = left.column("g")[0].as_py(), _load(left, width)
        told = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_unpack6(x.as_py()) for x in right.column("blob")]]))
        prints, multi = _repeats(g)
        known = np.concatenate([prints[multi], told >> np.uint64(1)])
        repeats, hot = np.isin(g.prints, known), np.isin(g.prints, told[(told & np.uint64(1)) == 1] >> np.uint64(1))
        i = np.flatnonzero(repeats)
        low, high, doc = g.low[i], g.high[i], g.ids[g.doc[i]]
        text = _contexts(g, i, low, high)
        # identical contexts: the smallest document goes on, for its other places too
        full = np.concatenate([text, low[:, None].astype(np.uint8), high[:, None].astype(np.uint8)], axis=1)
        hashes = _row_hash(full)
        order = np.lexsort((doc, hashes))
        head = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(i) else np.zeros(0, bool)
        lead = np.zeros(len(i), np.int64)
        lead[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(i) else order
        for k in range(0, len(i), 1 << 15):  # other rows of the same hash stand for themselves
            rows_k = np.arange(k, min(len(i), k + (1 << 15)))
            bad = (full[rows_k] != full[lead[rows_k]]).any(axis=1)
            lead[rows_k[bad]] = rows_k[bad]
        later = doc > doc[lead]
        mask = np.where(later, ((np.int64(2) << high) - 1) & ~((np.int64(1) << low) - 1), 0).astype(np.uint32)
        alias = np.where(later, i, i[lead] if len(i) else i)
        out = [(own, own % n_buckets, 3, _squeeze(i.astype(np.uint32), alias.astype(np.uint32), mask))]
        leads = lead == np.arange(len(i))
        j = np.flatnonzero(leads & ~hot[i])
        kgram = np.ascontiguousarray(text[j, span : span + K]).view(f"S{K}").ravel()
        part = (g.prints[i[j]] % np.uint64(per_range)).astype(np.int64)
        for b, r in _deal(np.searchsorted(splitters, kgram, "right").astype(np.int64) * per_range + part):
            r = j[r]
            out.append((own, b, 1, _squeeze(doc[r], i[r].astype(np.uint32), low[r].astype(np.uint8), high[r].astype(np.uint8), text[r])))
        j = np.flatnonzero(leads & hot[i])
        for o in range(span + 1):
            if len(r := j[(low[j] <= o) & (o <= high[j])]):
                window = text[r, span - o : span - o + width]
                for b, q in _deal((_row_hash(window) % np.uint64(n_buckets)).astype(np.int64)):
                    out.append((own, b, 2, _squeeze(doc[r[q]], i[r[q]].astype(np.uint32), np.full(len(q), o, np.uint32), window[q])))
        return _spare(_table(out, ["g", "b", "kind", "blob"]))

    def compare(table: pa.Table) -> pa.Table:
        groups, kinds, blobs = table.column("g").to_numpy(), table.column("kind").to_numpy(), [x.as_py() for x in table.column("blob")]
        out = [(int(groups[x]), 3, blobs[x]) for x in np.flatnonzero(kinds == 3)]
        answers = []
        if len(own := np.flatnonzero(kinds == 1)):
            parts = [_unsqueeze(blobs[x], 14 + context, "<i8", "<u4", "u1", "u1", f"u1:{context}") for x in own]
            of = np.repeat(groups[own], [len(p[0]) for p in parts])
            doc, place, low, high, text = (np.concatenate(x) for x in zip(*parts))
            answers.append((of, place, resolve(text, low, high, doc, width)))
        if len(own := np.flatnonzero(kinds == 2)):
            parts = [_unsqueeze(blobs[x], 16 + width, "<i8", "<u4", "<u4", f"u1:{width}") for x in own]
            of = np.repeat(groups[own], [len(p[0]) for p in parts])
            doc, place, o, window = (np.concatenate(x) for x in zip(*parts))
            answers.append((of, place, np.where(_earlier(_equal_rows(window), doc), np.uint32(1) << o, 0).astype(np.uint32)))
        for of, place, mask in answers:
            i = np.flatnonzero(mask)
            out += [(g, 1, _squeeze(place[i[j]], mask[i[j]])) for g, j in _deal(of[i])]
        return _spare(_table(out, ["g", "kind", "blob"]))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        g, left = _load(left, width)
        mask, alias = np.zeros(len(g.at), np.uint32), np.arange(len(g.at))
        for kind, blob in zip(right.column("kind").to_pylist(), right.column("blob")):
            if kind == 3:
                place, to, own = _unsqueeze(blob.as_py(), 12, "<u4", "<u4", "<u4")
                mask[place] |= own
                alias[place] = to
            else:
                place, own = _unsqueeze(blob.as_py(), 8, "<u4", "<u4")
                np.bitwise_or.at(mask, place, own)
        mask |= mask[alias]
        edge = np.zeros(len(g.buf) + 1, np.int16)
        for o in range(span + 1):
            s = g.at[(mask >> np.uint32(o)) & np.uint32(1) == 1] - o
            np.add.at(edge, s, 1)
            np.add.at(edge, s + width, -1)
        gone = np.cumsum(edge, dtype=np.int16)[: len(g.buf)] > 0
        spans, kept = [], []
        given = left.column("text")
        for k, (a, b) in enumerate(zip(g.starts, g.ends)):
            own = gone[a:b]
            turns = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))) if own.any() else np.zeros(0, int)
            runs = [(int(x), int(y)) for x, y in turns.reshape(-1, 2)]
            spans.append([{"start": x, "stop": y} for x, y in runs])
            if as_text:
                kept.append(text_without(given[k].as_py(), runs) if given[k].is_valid else None)
            else:
                kept.append((g.buf[a:b][~own] if runs else g.buf[a:b]).tobytes())
        columns = {"doc_id": left.column("id"), "n_bytes": pa.array(g.ends - g.starts, pa.int64())}
        columns |= {"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "kept": pa.array(kept, pa.string() if as_text else pa.binary())}
        return _spare(pa.table(columns | {f"c{i}": left.column(f"c{i}") for i in range(len(keep))}))

    prints = dealt.groupBy("g").applyInArrow(send_prints, "g long, b long, blob binary")
    repeats = prints.groupBy("b").applyInArrow(count_prints, "g long, blob binary")
    contexts = dealt.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(send_contexts, "g long, b long, kind int, blob binary")
    answers = contexts.groupBy("b").applyInArrow(compare, "g long, kind int, blob binary")
    kinds = dict(rows.dtypes)
    schema = "doc_id long, n_bytes long, spans array<struct<start: bigint, stop: bigint>>, kept " + ("string" if as_text else "binary") + "".join(f", c{i} {kinds[f'c{i}']}" for i in range(len(keep)))
    out = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(finish, schema)
    return out.select("doc_id", "n_bytes", "spans", "kept", *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])


def _splitters(rows: DataFrame, n_docs: int, n_buckets: int, width: int) -> np.ndarray:
    """Up to n_buckets - 1 k-grams that cut a sample of anchors into even parts."""

    def some(batches):
        for batch in batches:
            found = []
            for t in batch.column(0):
                g = Group([t.as_py()], np.zeros(1, np.int64), width)
                for a in g.at[np.argsort(g.prints)[:SAMPLE_ANCHORS]]:
                    found.append((g.buf[a : a + K].tobytes(),))
            yield _table(found, ["kgram"]).combine_chunks().to_batches()[0] if found else pa.RecordBatch.from_arrays([pa.array([], pa.binary())], ["kgram"])

    if n_buckets < 2:
        return np.zeros(0, f"S{K}")
    few = rows.select("text").where("text is not null").sample(min(1.0, SAMPLE_DOCS / max(n_docs, 1)), 17)
    found = np.sort(np.array([r[0] for r in few.mapInArrow(some, "kgram binary").toLocalIterator()], f"S{K}"))
    return np.unique(found[(np.arange(1, n_buckets) * len(found)) // n_buckets]) if len(found) else found


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def text_without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text outside spans, each first shrunk to whole characters."""
    out, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = max(at, b)
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """docs with the repeated strings gone from their texts, in the same columns. Only whole
    characters go; a null text stays null; a text that goes wholly becomes empty."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    done = cut(docs.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate((id_col, text_col, *others))]), "x0", "x1", width, tuple(f"x{i + 2}" for i in range(len(others))), as_text=True)
    kinds = dict(docs.dtypes)
    names = {id_col: F.col("doc_id").cast(kinds[id_col]), text_col: F.col("kept")} | {c: F.col(f"x{i + 2}") for i, c in enumerate(others)}
    return done.select(*[names[c].alias(c) for c in docs.columns])
