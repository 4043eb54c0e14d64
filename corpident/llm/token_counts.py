"""Token counts that follow edits.

A text's pre-tokens (matches of the tokenizer's pattern) are gathered into leaves of about
LEAF characters, cut only where the tokens of the parts are those of the whole. A segment
tree over the leaves keeps the sums of characters, tokens and pre-tokens. An edit finds the
leaves it touches by descending the sums, re-encodes those with the edit (and a neighbour,
where the cut between them is spoiled), and updates the sums on their paths.

Where a text may be cut, from the two characters beside the place alone:

- before white space that follows anything else, between a letter or number and a character
  of another class, and before a number: the pattern ends a pre-token there whatever stands
  around it, has no look-behind, and its one look-ahead only matters after white space;
- between a letter beyond ASCII and another letter, if no token of the vocabulary holds the
  two bytes that meet there: no merge can then cross the place, though it lies inside a
  pre-token (which is counted in the leaf where it begins). So scripts without spaces have leaves.

Edits are an array column of (start, stop, text), in code points, each on the text as the
edits before it left it. Out-of-range places are moved to the ends; stop below start counts
as start.

Nulls and edge cases: a null text is empty; null edits are none, a null edit is left out,
null places count as the end, a null replacement is empty; texts without a place to cut are
one leaf, however long; repeated rows and rows with a null id are counted like any other;
an empty table gives an empty result; other columns are ignored. Special tokens' strings in
a text are ordinary text.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that goes with the vocabulary. Fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf, at least; texts of more than so many are cut again when an edit brings them.
LEAF, LONG = 16, 128
COUNTS = "doc_id long, n_chars long, n_tokens long, n_pretokens long, n_tokens_edited long, n_pretokens_edited long, n_chars_edited long, n_chars_encoded long"
#: What a place between two characters is: no cut, a cut between pre-tokens, a cut inside one.
NO, BETWEEN, INSIDE = 0, 1, 2


class Vocabulary:
    """Encodes, counts, and knows where texts may be cut."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.encode, self.find = encoding.encode_ordinary, regex.compile(PATTERN).findall
        self.sizes = np.zeros(max(table.values(), default=0) + 1, np.int64)
        self.pairs = bytearray(1 << 16)
        for token, rank in table.items():
            self.sizes[rank] = len(token)
            for x, y in zip(token, token[1:]):
                self.pairs[x << 8 | y] = 1
        self._classes = [(name, regex.compile(p).match) for name, p in (("s", r"\s"), ("L", r"\p{L}"), ("N", r"\p{N}"))]
        self._class: dict[str, str] = {}
        self._cuts: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[int, int]:
        """Tokens and pre-tokens of a text."""
        return len(self.encode(text)), len(self.find(text))

    def class_of(self, c: str) -> str:
        """s white space, L letter, N number, P else."""
        if c not in self._class:
            self._class[c] = next((name for name, match in self._classes if match(c)), "P")
        return self._class[c]

    def cut(self, a: str, b: str) -> int:
        """Whether a text may be cut between the characters a and b."""
        found = self._cuts.get(a + b)
        if found is None:
            x, y = self.class_of(a), self.class_of(b)
            if x == "s":
                found = NO
            elif y == "s" or (x != y and (x != "P" or y == "N")):
                found = BETWEEN
            else:
                inside = x == y == "L" and ord(a) > 127 and not self.pairs[a.encode()[-1] << 8 | b.encode()[0]]
                found = INSIDE if inside else NO
            if len(self._cuts) < 1 << 18:
                self._cuts[a + b] = found
        return found

    def leaves(self, text: str, size: int = LEAF) -> tuple[list[str], list[int]]:
        """The leaves of a text, and how many pre-tokens begin in each."""
        parts, counts, own, n, length = [], [], [], 0, 0
        for t in self.find(text):
            if length >= size and self.cut(own[-1][-1], t[0]) == BETWEEN:
                parts.append("".join(own))
                counts.append(n)
                own, n, length = [], 0, 0
            n += 1
            if len(t) > 2 * size and not t.isascii():
                at = 0
                for i in range(1, len(t)):
                    if length + i - at >= size and self.cut(t[i - 1], t[i]) == INSIDE:
                        parts.append("".join([*own, t[at:i]]))
                        counts.append(n)
                        own, n, length, at = [], 0, 0, i
                t = t[at:]
            own.append(t)
            length += len(t)
        if own:
            parts.append("".join(own))
            counts.append(n)
        return parts, counts

    def measured(self, text: str, size: int = LEAF) -> tuple[list[str], np.ndarray]:
        """The leaves, and (characters, tokens, pre-tokens) of each, from one encoding of the text."""
        parts, counts = self.leaves(text, size)
        out = np.zeros((len(parts), 3), np.int64)
        if parts:
            out[:, 0] = [len(p) for p in parts]
            out[:, 2] = counts
            ends = np.cumsum(out[:, 0]) if text.isascii() else np.cumsum([len(p.encode()) for p in parts])
            tokens = np.cumsum(self.sizes[np.array(self.encode(text), np.int64)])
            out[:, 1] = np.diff(np.searchsorted(tokens, ends, "right"), prepend=0)
        return parts, out


def counter(ranks: bytes) -> Vocabulary:
    """One per worker process and vocabulary."""
    kept = sys.modules.setdefault("_corpident_worker", types.ModuleType("_corpident_worker")).__dict__
    key = ("counter", hash(ranks))
    if key not in kept:
        kept[key] = Vocabulary(ranks)
    return kept[key]


class SegmentTree:
    """Sums of characters, tokens and pre-tokens over a document's leaves."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        self.vocabulary, self.encoded = vocabulary, 0
        self._build(*self._measured(text))

    def _measured(self, text: str) -> tuple[list[str], np.ndarray]:
        self.encoded += len(text)
        return self.vocabulary.measured(text)

    def _build(self, parts: list[str], known: np.ndarray) -> None:
        self.parts = parts
        self.width = 1 << max(0, len(parts) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        self.sums[self.width : self.width + len(parts)] = known
        half = self.width // 2
        while half:
            self.sums[half : 2 * half] = self.sums[2 * half : 4 * half : 2] + self.sums[2 * half + 1 : 4 * half : 2]
            half //= 2

    def _set(self, leaf: int, counts: tuple[int, int, int] | np.ndarray) -> None:
        i = leaf + self.width
        change = np.array(counts, np.int64) - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place, and its first character's place."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place >= start + self.sums[i, 0]:
                start += int(self.sums[i, 0])
                i += 1
        return i - self.width, start

    @property
    def total(self) -> tuple[int, int, int]:
        return tuple(int(x) for x in self.sums[1])

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.parts):
            if self.parts[leaf]:
                return leaf
            leaf += step
        return None

    def _cut(self, left: int | None, right: int | None) -> int:
        """What the place between two leaves is; BETWEEN at the ends of the text."""
        return BETWEEN if left is None or right is None else self.vocabulary.cut(self.parts[left][-1], self.parts[right][0])

    def replace(self, start: int, stop: int, text: str) -> None:
        n = self.total[0]
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if not n:
            return self._build(*self._measured(text))
        first, at = self.find(min(start, n - 1))
        last, last_at = self.find(min(max(stop - 1, start), n - 1))
        left, right = self._beside(first, -1), self._beside(last, 1)
        was_inside = self._cut(last, right) == INSIDE
        new = self.parts[first][: start - at] + text + self.parts[last][stop - last_at :]
        cut = self.vocabulary.cut
        # take in a neighbour while there is no cut beside it any more
        while left is not None and (not new or not cut(self.parts[left][-1], new[0])):
            new, first = self.parts[left] + new, left
            left = self._beside(first, -1)
        while right is not None and (not new or not cut(new[-1], self.parts[right][0])):
            new, last = new + self.parts[right], right
            right = self._beside(last, 1)
            was_inside = self._cut(last, right) == INSIDE
        parts, known = self._measured(new)
        if parts and left is not None and cut(self.parts[left][-1], new[0]) == INSIDE:
            known[0, 2] -= 1  # begins in the leaf before
        is_inside = bool(new) and right is not None and cut(new[-1], self.parts[right][0]) == INSIDE
        if right is not None and was_inside != is_inside:
            own = self.sums[right + self.width].copy()
            own[2] += int(was_inside) - int(is_inside)
            self._set(right, own)
        if len(new) > LONG and len(parts) > last - first + 1:
            sums = self.sums[self.width : self.width + len(self.parts)]
            return self._build([*self.parts[:first], *parts, *self.parts[last + 1 :]], np.concatenate([sums[:first], known, sums[last + 1 :]]))
        for leaf in range(first, last + 1):
            own = leaf - first
            # the last leaf of the range takes what is left; the others of a short text stay empty
            rest = own == last - first
            self.parts[leaf] = "".join(parts[own:]) if rest else parts[own] if own < len(parts) else ""
            self._set(leaf, known[own:].sum(axis=0) if rest else known[own] if own < len(parts) else (0, 0, 0))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document, see COUNTS: counts before and after the edits, and the characters
    that were encoded for the edits (n_chars_encoded). edits: array<struct<start, stop, text>>."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks.value)
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            out = []
            for text, changes in zip(batch.column(1), batch.column(2)):
                tree = SegmentTree(text.as_py() or "", own)
                before, tree.encoded = tree.total, 0
                for e in changes.as_py() or []:
                    if e is not None:
                        end = tree.total[0]
                        tree.replace(end if e["start"] is None else e["start"], end if e["stop"] is None else e["stop"], e["text"] or "")
                after = tree.total
                out.append((*before, after[1], after[2], after[0], tree.encoded))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names)

    none = F.lit(None).cast("array<struct<start: bigint, stop: bigint, text: string>>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (none if edits is None else edits).alias("edits"))
    return rows.mapInArrow(run, COUNTS)
