"""Quality by attention over passages: a text is a bag of passages, of which labels say something only as a whole.

Every passage of a text is encoded; a gated attention, learned from labels of whole documents, weighs the encodings; the weighted sum is
scored. The model has a few thousand numbers and is fitted on at most ``most_rows`` labelled documents; scoring is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.shared import documents, kept, prefix_hashes, span_hashes, text_blocks, window_hashes, word_spans

PASSAGE_WORDS = 64
WORD_BUCKETS = 32
MEASURES = 13
#: Labelled documents a model is fitted on at most: those of the least hashes of ids.
MOST_ROWS = 3000
HIDDEN, GATES, STEPS, RATE, DECAY = 24, 12, 300, 0.02, 1e-4
GOOD_FROM = 0.7


def _classes() -> np.ndarray:
    """Byte -> bits of what it is: capital, small letter, digit, symbol of markup, other punctuation, not ASCII, line break."""
    kinds = np.zeros((7, 256), np.int8)
    kinds[0, 65:91] = kinds[1, 97:123] = kinds[2, 48:58] = 1
    kinds[3, list(b"#*$%&|<>")] = 1
    kinds[4, [b for b in range(33, 127) if not chr(b).isalnum() and not kinds[3, b]]] = 1
    kinds[5, 128:] = kinds[6, 10] = 1
    return kinds


def passages(column: pa.Array, passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, encoding inputs) of the passages of all texts, in order of rows; a text without words has one passage of zeros."""
    kinds = _classes()
    rows_out, inputs = [], []
    for data, rows, _, bounds in text_blocks(column, 0, at_space=True):
        starts, ends = word_spans(data)
        if not len(starts):
            continue
        piece = np.searchsorted(bounds[:, 1], starts, side="right")
        heads = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1])
        place = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
        first = np.flatnonzero(place % passage_words == 0)
        passage = np.cumsum(place % passage_words == 0) - 1
        m, count = len(first), np.diff(np.append(first, len(starts))).astype(np.float64)
        low, high = starts[first], ends[np.append(first[1:], len(starts)) - 1]
        size = (high - low).astype(np.float64)
        word_bytes = np.bincount(passage, ends - starts, m)
        x = np.zeros((m, MEASURES + WORD_BUCKETS))
        for k in range(7):
            total = np.concatenate([[0], np.cumsum(kinds[k][data], dtype=np.int64)])
            x[:, k] = (total[high] - total[low]) / np.maximum(size, 1)
        x[:, 7] = word_bytes / count / 8
        x[:, 8] = np.bincount(passage, ends - starts <= 3, m) / count
        hashes = span_hashes(prefix_hashes(data), starts, ends)
        x[:, 9] = _distinct(hashes, passage, m) / count
        grams = window_hashes(hashes, 3)
        inside = passage[: len(grams)] == passage[2 : 2 + len(grams)] if len(grams) else np.zeros(0, bool)
        n_grams = np.bincount(passage[: len(grams)][inside], minlength=m)
        x[:, 10] = np.where(n_grams > 0, _distinct(grams[inside], passage[: len(grams)][inside], m) / np.maximum(n_grams, 1), 1)
        letters = np.concatenate([[0], np.cumsum((kinds[0] + kinds[1] + kinds[5])[data], dtype=np.int64)])
        x[:, 11] = np.bincount(passage, letters[ends] == letters[starts], m) / count
        x[:, 12] = np.log1p(count) / np.log(passage_words + 1)
        cell = passage * WORD_BUCKETS + (hashes >> np.uint64(59)).astype(np.int64) % WORD_BUCKETS
        x[:, MEASURES:] = np.bincount(cell, minlength=m * WORD_BUCKETS).reshape(m, WORD_BUCKETS) / np.sqrt(count)[:, None] / 4
        rows_out.append(rows[piece[first]])
        inputs.append(x.astype(np.float32))
    row = np.concatenate(rows_out) if rows_out else np.zeros(0, np.int64)
    x = np.concatenate(inputs) if inputs else np.zeros((0, MEASURES + WORD_BUCKETS), np.float32)
    empty = np.setdiff1d(np.arange(len(column)), row)
    row = np.concatenate([row, empty])
    x = np.concatenate([x, np.zeros((len(empty), x.shape[1]), np.float32)])
    order = np.argsort(row, kind="stable")
    return row[order], x[order]


def _distinct(hashes: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Number of different hashes (at 40 bits) in each group."""
    both = np.unique((group.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    return np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=groups)


def _forward(model: dict, x: np.ndarray, heads: np.ndarray, bag: np.ndarray) -> dict:
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (t * g) @ model["w"]
    e = np.exp(e - np.maximum.reduceat(e, heads)[bag])
    a = e / np.add.reduceat(e, heads)[bag]
    z = np.add.reduceat(a[:, None] * h, heads, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": 1 / (1 + np.exp(-(z @ model["c"] + model["d"])))}


def _bags(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    return heads, np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(row))))


def fit(row: np.ndarray, x: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> dict:
    """Model from passages (ordered by row) and one label per row. Deterministic. One class only or no rows: its share is the score."""
    rng = np.random.default_rng(11)
    width = x.shape[1] if x.ndim == 2 else MEASURES + WORD_BUCKETS
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = {
        "mean": x.mean(0) if len(x) else np.zeros(width), "scale": (x.std(0) + 0.02) if len(x) else np.ones(width),
        "W": rng.normal(0, width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "w": rng.normal(0, GATES**-0.5, GATES), "c": rng.normal(0, 0.01, HIDDEN),
        "d": np.log(share / (1 - share)),
    }
    if not len(labels) or labels.min() == labels.max():
        model["c"][:] = 0
        return model
    heads, bag = _bags(row)
    names = ["W", "b", "V", "U", "w", "c", "d"]
    first, second = ({n: np.zeros_like(model[n]) for n in names} for _ in range(2))
    for step in range(1, steps + 1):
        f = _forward(model, x, heads, bag)
        ds = (f["s"] - labels) / len(labels)
        dz = ds[:, None] * model["c"]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, heads)[bag])
        dtg = de[:, None] * model["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz[bag] + dt @ model["V"].T + dg @ model["U"].T
        dx = dh * (1 - f["h"] ** 2)
        grads = {
            "W": f["x"].T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(),
        }
        for n in names:
            grad = grads[n] + DECAY * model[n]
            first[n] = 0.9 * first[n] + 0.1 * grad
            second[n] = 0.999 * second[n] + 0.001 * grad**2
            rate = RATE * min(1, 3 * (1 - step / (steps + 1)))
            model[n] = model[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS,
    passage_words: int = PASSAGE_WORDS,
) -> dict:
    """Fit on labelled rows that are not held out, at most ``most_rows`` of them: those whose ids have the least hashes.

    Null labels and ids are left out; several labels of one id count by the greatest. Texts don't reach the driver, but the
    passages' inputs do (45 numbers each, of at most most_rows documents).
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("double")).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = passages(batch.column(2), passage_words)
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            stops = np.append(heads[1:], len(row))
            packed = [x[a:b].tobytes() for a, b in zip(heads, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "label", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = kept(texts.mapInArrow(encode, f"id {kind}, label double, x binary"), "classifier-rows").orderBy("id", "x").toArrow()
    parts = [np.frombuffer(b, np.float32).reshape(-1, MEASURES + WORD_BUCKETS) for b in got.column("x").to_pylist()]
    x = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, MEASURES + WORD_BUCKETS))
    return fit(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), x, got.column("label").to_numpy())


def score(docs: DataFrame, model: dict, text_col: str = "text", passage_words: int = PASSAGE_WORDS, good_from: float = GOOD_FROM) -> DataFrame:
    """docs with ``score`` double (0 to 1) and ``predicted`` int (1 from good_from). Only the text is looked at.

    Null and empty texts are scored as one passage of zeros; equal texts get equal scores. Columns of these names are replaced.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, x = passages(part.column(text_at), passage_words)
                heads, bag = _bags(row)
                s = np.round(_forward(model, x.astype(np.float64), heads, bag)["s"], 9)
                columns = [part.column(k) for k in kept_at] + [pa.array(s), pa.array((s >= good_from).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "score", "predicted"])

    # Each text goes to Python once, and comes back once.
    text_at = docs.columns.index(text_col)
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    kept_at = [docs.columns.index(c) for c in rest]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return docs.mapInArrow(scored, f"{fields}score double, predicted int")


def query(spark, folder: str) -> DataFrame:
    """All documents scored by a model of the labelled ones that are not held out."""
    docs = documents(spark, folder, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_classifier": (query, None)}
