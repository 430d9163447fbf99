"""Language identification with a small convolutional network over bytes.

A text's UTF-8 bytes (A-Z in lower case) are cut into windows that overlap by the
widest filter, so every run of bytes in the whole text is seen once.  Bytes are
embedded, filters of several widths run over them, each filter keeps its maximum,
and a softmax layer scores the languages.  A text's score is the mean over its
windows by length.  The network is trained here, in numpy, on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import uniform
from .words import whole

UNKNOWN = "und"
#: Bytes of text whose windows are held at once.
PIECE = 1 << 20


def pieces(offsets: np.ndarray, limit: int):
    """Ranges of rows of about *limit* bytes; a longer row stands alone."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, stop
        start = stop


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x e
    kernel: np.ndarray  # (widest * e) x filters; narrower filters are zero at the end
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    window: int
    widest: int

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes below each position of ``windows`` (n x (window + widest - 1))."""
        x = self.embed[windows]
        parts = [x[:, k:x.shape[1] - self.widest + 1 + k] for k in range(self.widest)]
        return np.concatenate(parts, axis=2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        a = self.columns(windows)
        n, length, depth = a.shape
        z = (a.reshape(n * length, depth) @ self.kernel).reshape(n, length, -1)
        return np.maximum(z.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray, step: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for i in range(0, len(windows), step):
            z = self.pooled(windows[i:i + step]) @ self.dense + self.offset
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[i:i + step] = e / e.sum(axis=1, keepdims=True)
        return out

    def cut(self, data, starts, ends, limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, windows, length)`` of the spans ``data[starts:ends]``; none for an empty one.

        A window looks beyond its span up to the end of its text (*limits*), then sees zeros.
        """
        n = -(-(ends - starts) // self.window)
        row = np.repeat(np.arange(len(n)), n)
        first = starts[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * self.window
        position = first[:, None] + np.arange(self.window + self.widest - 1)
        inside = position < limits[row][:, None]
        windows = np.zeros(position.shape, np.uint8)
        windows[inside] = data[position[inside]]
        return row, windows, np.minimum(self.window, ends[row] - first)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(index of the label, score)`` of each text; a text without bytes scores 0."""
        low = whole(texts)
        offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset:low.offset + len(low) + 1]
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
        total = np.zeros((len(low), len(self.labels)))
        for i, j in pieces(offsets, PIECE):
            if j - i == 1:  # a long text goes in turns of whole windows
                turn = PIECE // self.window * self.window
                spans = [(a, min(a + turn, offsets[j])) for a in range(offsets[i], offsets[j], turn)]
            else:
                spans = [(offsets[i], offsets[j])]
            for a, b in spans:
                ends = np.minimum(offsets[i + 1:j + 1], b)
                row, windows, length = self.cut(data, np.maximum(offsets[i:j], a), ends, offsets[i + 1:j + 1])
                np.add.at(total[i:j], row, self.probabilities(windows) * length[:, None])
        size = np.maximum(np.diff(offsets), 1)
        total /= size[:, None]
        return total.argmax(axis=1), total.max(axis=1)


def training_windows(
    labelled: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id",
    per_label: int = 400, crops: int = 4, window: int = 512, max_labels: int = 1000,
) -> list[tuple[str, str]]:
    """A bounded sample of ``(label, window)``: *per_label* documents of each label, *crops* windows each.

    Documents are drawn by a hash of *key* from all labelled rows whose text has a
    letter; windows start anywhere in a text and get shorter by turns.  Null labels
    are left out, and labels beyond the *max_labels* most frequent are not learned.  The driver receives at most ``labels * per_label * crops *
    window`` characters.
    """
    rows = labelled.select(
        F.col(label).alias("label"), F.col(text).alias("text"), uniform(F.col(key), "language").alias("u"), F.col(key).alias("key"),
    ).where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # rows below the bound are drawn first, so no label is ever ranked as a whole
    few = rows.join(F.broadcast(counts.orderBy(F.desc("n"), "label").limit(max_labels)), "label").where(F.col("u") * F.col("n") < 2 * per_label)
    size = F.array(*(F.lit(max(16, window >> (i % 4))) for i in range(crops)))
    windows = few.select(
        "label", "u", "key",
        F.transform(size, lambda s, i: F.substr(
            "text", (1 + F.floor(F.greatest(F.length("text") - s, F.lit(0)) * ((F.col("u") * 7919 * (i + 1)) % 1))).cast("int"),
            s)).alias("windows"),
    )
    first = F.row_number().over(Window.partitionBy("label").orderBy("u", "key"))
    kept = windows.withColumn("n", first).where(F.col("n") <= per_label).orderBy("label", "n")
    return [(r.label, w) for r in kept.select("label", "windows").collect() for w in r.windows]


def train(
    samples: list[tuple[str, str]], *, window: int = 512, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16,
    depth: int = 8, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 7,
) -> Network:
    """Fit the network to ``(label, text)`` samples with Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for label, _ in samples})
    widest, n_filters = max(widths), filters * len(widths)
    mask = np.zeros((widest, depth, n_filters), np.float32)
    for i, w in enumerate(widths):
        mask[:w, :, i * filters:(i + 1) * filters] = 1
    mask = mask.reshape(widest * depth, n_filters)
    net = Network(
        labels, rng.normal(0, 0.3, (256, depth)).astype(np.float32),
        (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32), np.zeros(n_filters, np.float32),
        rng.normal(0, 0.1, (n_filters, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32), window, widest,
    )
    if not samples:
        return net
    data = np.zeros((len(samples), window + widest - 1), np.uint8)
    for i, (_, text) in enumerate(samples):
        raw = pc.ascii_lower(pa.scalar(text)).as_py().encode()[:window]
        data[i, :len(raw)] = np.frombuffer(raw, np.uint8)
    target = np.array([labels.index(label) for label, _ in samples])
    names = ("embed", "kernel", "bias", "dense", "offset")
    moment = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x, n = data[pick], len(pick)
            a = net.columns(x)
            z = (a.reshape(-1, a.shape[2]) @ net.kernel).reshape(n, -1, n_filters)
            best = z.argmax(axis=1)
            raw = np.take_along_axis(z, best[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ net.dense + net.offset
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(n), target[pick]] -= 1
            d /= n
            dh = (d @ net.dense.T) * (raw > 0)
            at_best = a[np.arange(n)[:, None], best]  # n x filters x depth of a column
            gradient = {
                "dense": hidden.T @ d, "offset": d.sum(axis=0), "bias": dh.sum(axis=0),
                "kernel": np.einsum("nf,nfd->df", dh, at_best) * mask, "embed": np.zeros_like(net.embed),
            }
            back = (dh[:, :, None] * net.kernel.T[None]).reshape(n, n_filters, widest, depth)
            chars = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(widest)]
            np.add.at(gradient["embed"], chars.ravel(), back.reshape(-1, depth))
            step += 1
            for k in names:
                m, v = moment[k]
                m += 0.1 * (gradient[k] - m)
                v += 0.001 * (gradient[k] ** 2 - v)
                getattr(net, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def detect(text: Column, net: Network) -> Column:
    """``struct(lang, score)`` of a text column.

    ``lang`` is a learned label, or ``und`` with score 0 if the text is null or has
    no letter, or if nothing was learned.  ``score`` is between 0 and 1, rounded to 6 places.
    """
    @F.arrow_udf("struct<lang: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if net.labels:
            index, score = net.predict(texts)
        else:
            letters, index, score = letters & False, np.zeros(len(texts), int), np.zeros(len(texts))
        names = np.array([*net.labels, UNKNOWN], dtype=object)
        lang = np.where(letters, names[index], UNKNOWN)
        score = np.where(letters, np.round(np.clip(score, 0, 1), 6), 0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return run(text)
