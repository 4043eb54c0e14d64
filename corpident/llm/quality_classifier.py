"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are native expressions over whole texts. The model is fitted on the driver
from a bounded sample: at most `max_rows` labelled documents (those of least id hash), so
what is collected is at most max_rows x the number of features. Trees grow level by level on
256-bin histograms, are flattened into arrays, and executors walk all rows of a batch down a
tree at once with numpy.

Nulls and edge cases: a null text counts as empty and is scored; labels that are null or
other than 0 and 1, or whose id is null or has no document, teach nothing; of several labels
of an id the smallest counts; rows with a null id are scored; repeated rows are scored alike;
without any label, or with labels of one kind only, every score is the smoothed share of 1s
(0.5 without labels); an empty table gives an empty result; other columns are carried only
if named in keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: The most labelled documents that a model is fitted on.
MAX_ROWS = 20000
BINS = 256


def statistics(text: Column) -> Column:
    """An array of doubles about a text; none depends on its language, source or id."""

    def of(t: Column) -> Column:
        chars = F.length(t).cast("double")
        count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
        share = lambda n, of_what: F.when(of_what > 0, n / of_what).otherwise(F.lit(0.0))

        def over(w: Column) -> Column:
            n = F.size(w).cast("double")
            lines = F.split(t, "\n")
            n_lines = F.size(lines).cast("double")
            spaces = count(r"[\x20\x09-\x0D]")
            return F.array(
                F.log1p(chars),
                F.log1p(n),
                share(chars - spaces, n),
                share(F.size(F.array_distinct(w)).cast("double"), n),
                share(F.size(F.array_distinct(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))))).cast("double"), n),
                share(F.size(F.array_distinct(lines)).cast("double"), n_lines),
                share(n, n_lines),
                share(count(r"[#*$%&|<>]"), chars),
                share(count(r"[!?]"), chars),
                share(count(r"[.,;:]"), chars),
                share(count(r"[0-9]"), chars),
                share(count(r"\p{Lu}"), chars),
                share(count(r"(?:^|[\x20\x09-\x0D])\p{Lu}{2,}"), n),
                share(count(r"[^\p{L}\p{N}\s]"), chars),
                share(count(r"[^\p{L}\s]{2,}(?=\s|$)"), n),
                share(spaces, chars),
                share(count(r"(?:^|[\x20\x09-\x0D])[^\p{L}\p{N}\s]+(?=[\x20\x09-\x0D]|$)"), n),
            )

        return let(F.regexp_extract_all(t, F.lit(f"({WORD})")), over)

    return let(F.coalesce(text, F.lit("")), of)


class Trees:
    """Boosted trees as flat arrays: per node the feature (-1: a leaf), the greatest value that
    goes left, the left child (the right one follows it) and the leaf's value."""

    def __init__(self, base: float, roots: list[int], feature: list[int], cut: list[float], child: list[int], value: list[float], depth: int):
        self.base, self.roots, self.depth = base, roots, depth
        self.feature, self.cut, self.child, self.value = np.array(feature, np.int64), np.array(cut), np.array(child, np.int64), np.array(value)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of x."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.cut[at]
                at = np.where(inner, self.child[at] + right, at)
            out += self.value[at]
        return 1.0 / (1.0 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 1.0, least: float = 5.0) -> Trees:
    """Second-order boosting of the log loss; splits by gain over histograms of binned features."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model: dict[str, list] = {"feature": [], "cut": [], "child": [], "value": []}
    base, roots = float(np.log(share / (1 - share))), []
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, roots, [-1], [0.0], [0], [0.0], 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), base)

    def node() -> int:
        for k, v in (("feature", -1), ("cut", 0.0), ("child", 0), ("value", 0.0)):
            model[k].append(v)
        return len(model["feature"]) - 1

    for _ in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for at, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, None)
                for f in range(x.shape[1] if d < depth else 0):
                    if not len(edges[f]):
                        continue
                    own = binned[rows, f]
                    gs = np.cumsum(np.bincount(own, grad[rows], BINS))[: len(edges[f])]
                    hs = np.cumsum(np.bincount(own, hess[rows], BINS))[: len(edges[f])]
                    n = np.cumsum(np.bincount(own, minlength=BINS))[: len(edges[f])]
                    gain = gs**2 / (hs + smooth) + (g - gs) ** 2 / (h - hs + smooth) - g**2 / (h + smooth)
                    gain[(n < least) | (len(rows) - n < least)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), (f, int(gain.argmax())))
                if best[1] is None:
                    model["value"][at] = rate * g / (h + smooth)
                    raw[rows] += model["value"][at]
                    continue
                f, b = best[1]
                left = binned[rows, f] <= b
                model["feature"][at], model["cut"][at] = f, float(edges[f][b])
                model["child"][at] = node()
                below += [(model["child"][at], rows[left]), (node(), rows[~left])]
            level = below
    return Trees(base, roots, **model, depth=depth)


def held_out(id_col: Column) -> Column:
    """Rows that teach nothing: crc32 of the id, as text, is 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """A model of the labels, fitted on at most max_rows documents that are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # a bounded sample: max_rows ids and labels
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = rows.select("_doc", "_label", statistics(F.col("_text")).alias("x"))
    rows = rows.orderBy("_doc", "x").limit(max_rows).select("_label", "x").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
    return fit(x, rows.column("_label").to_numpy().astype(float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score double, and keep, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
            x = values.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "x"}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(model.scores(x), pa.float64())})

    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate((id_col, *keep))], statistics(F.col(text_col)).alias("x"))
    schema = ", ".join([*[f"{n} {k}" for n, k in rows.dtypes if n != "x"], "score double"])
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("c0").alias("doc_id"), "score", *[F.col(f"c{i + 1}").alias(c) for i, c in enumerate(keep)])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score at least threshold, in the same columns."""
    model = train(docs, labels, id_col, text_col)
    names = [f"k{i}" for i in range(len(docs.columns))]
    good = score(docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)]), model, names[docs.columns.index(id_col)], names[docs.columns.index(text_col)], keep=tuple(names))
    return good.where(F.col("score") >= threshold).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
