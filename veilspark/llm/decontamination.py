"""Find benchmark items in documents, copied or edited.

Word pairs of the items are looked up at every position of every document; each
meeting names a stretch of the document, and a Smith-Waterman alignment of the item
with that stretch gives the score.  An item's most common pairs are left out, but
only so many that every alignment that reaches the threshold still holds one of the
others: how common an item became decides what the search costs, not what it finds.
Items of a few words are looked up as whole sequences, and only exact copies count.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Meetings of seeds with a text that are looked at together.
MEETINGS = 1 << 17


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, hashes)`` of lower-case words without punctuation at their ends; bare punctuation is no word."""
    offsets, codes, vocabulary = words.split(texts, lower=False)
    vocabulary = pc.ascii_trim(pc.utf8_lower(vocabulary.take(pa.array(np.arange(len(vocabulary))))), EDGES)
    blank = np.asarray(pc.equal(vocabulary, ""))
    hashed = words.hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    kept = ~blank[codes] if len(codes) else np.zeros(0, bool)
    return np.concatenate(([0], np.cumsum(kept)))[offsets], hashed[kept]


class Items:
    """Benchmark items as arrays: their words, and their seeds in hash order."""

    def __init__(self, ids: list, texts: list[str | None], least_words: int):
        offsets, tokens = plain_words(pa.array(texts, pa.string()))
        worded = np.flatnonzero(np.diff(offsets) > 0)
        self.ids = [ids[i] for i in worded]
        self.words = [tokens[offsets[i]:offsets[i + 1]] for i in worded]
        self.least_words = least_words
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.seeds = np.zeros(0, np.uint64)

    def choose_seeds(self, share: np.ndarray, threshold: float) -> None:
        """Keep the rarest n-grams of each item that no alignment of *threshold* can do without.

        A score of *least* words needs that many more matches than edits, and matches lie in one run more
        than there are edits at most: *least* - 1 word pairs of the item are whole in the alignment.  All
        but *least* - 2 of its pairs are seeds, so one of them is met.  Where that needs no pair, single
        words are taken, of which *least* match.  An item of fewer than *least_words* words is one seed.
        """
        seed, item, place, grams = [], [], [], []
        self.size = np.array([len(w) for w in self.words], np.int64)
        short = self.size < self.least_words
        #: The score from which an alignment counts.
        self.threshold = np.where(short, 1.0, threshold)
        least = np.maximum(1, np.ceil(self.threshold * self.size - 1e-9).astype(np.int64))
        self.width = np.where(short, self.size, np.where(least > 1, 2, 1))
        self.need = least - self.width + 1
        #: An alignment reaches no farther than its edits beyond the item's place beside one of its matches.
        self.reach = np.maximum(self.size - least, 0) + 2
        for i, tokens in enumerate(self.words):
            width = int(self.width[i])
            p = np.log(np.maximum(share[np.searchsorted(self.vocabulary, tokens)], 1e-300))
            n = len(tokens) - width + 1
            found = words.shingles(np.array([0, len(tokens)]), tokens, width)[1]
            kept = np.argsort(sum(p[k:k + n] for k in range(width)), kind="stable")[:max(0, n - self.need[i] + 1)]
            seed.append(found[kept])
            item.append(np.full(len(kept), i))
            place.append(kept)
            grams.append(words.chain(found, np.uint64(i)))
        if seed:
            seed, item, place = map(np.concatenate, (seed, item, place))
            order = np.argsort(seed, kind="stable")
            self.seeds, self.item, self.place = seed[order], item[order], place[order]
            self.grams = np.unique(np.concatenate(grams))

    def hits(self, offsets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, item, diagonal)`` in order, once each, of seeds with enough n-grams of their item around them."""
        out = [(np.zeros(0, np.int64),) * 3]
        for width in np.unique(self.width).tolist() if len(self.seeds) else []:
            n = len(tokens) - width + 1
            if n <= 0:
                continue
            value = words.mix(tokens[:n] + np.uint64(width))
            whole = np.ones(n, bool)
            for k in range(1, width):
                value = words.chain(value, tokens[k:n + k])
                last = offsets - k
                whole[last[(last >= 0) & (last < n)]] = False
            at = np.flatnonzero(whole & (self.seeds[np.minimum(np.searchsorted(self.seeds, value), len(self.seeds) - 1)] == value))
            low, high = (np.searchsorted(self.seeds, value[at], side=s) for s in ("left", "right"))
            count = high - low
            # a frequent seed of many items: so many meetings at once
            ends = np.cumsum(count)
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MEETINGS, side="right")))
                c = count[start:stop]
                index = np.repeat(low[start:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                place = np.repeat(at[start:stop], c)
                text = np.searchsorted(offsets, place, side="right") - 1
                out.append(self._dense(offsets, value, width, *_once(text, self.item[index], place - self.place[index])))
                start = stop
        return _once(*map(np.concatenate, zip(*out)))

    def _dense(self, offsets, value, width, text, item, diagonal) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The meetings around which as many n-grams of the item lie as an alignment needs."""
        low = np.maximum(offsets[text], diagonal - self.reach[item])
        high = np.minimum(offsets[text + 1], diagonal + self.size[item] + self.reach[item]) - width + 1
        length = np.maximum(high - low, 0)
        kept = np.zeros(len(text), bool)
        ends, start = np.cumsum(length), 0
        while start < len(text):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 8 * MEETINGS, side="right")))
            c = length[start:stop]
            at = np.repeat(low[start:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            owner = np.repeat(np.arange(stop - start), c)
            key = words.chain(value[at], item[start:stop].astype(np.uint64)[owner])
            met = self.grams[np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)] == key
            kept[start:stop] = np.bincount(owner[met], minlength=stop - start) >= self.need[item[start:stop]]
            start = stop
        return text[kept], item[kept], diagonal[kept]


def _once(text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples in order."""
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal = text[order], item[order], diagonal[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0)
    return text[new], item[new], diagonal[new]


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores (match 1, mismatch and gap -1) of pairs, divided by the item's length."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(stretches[i])))
    for start in range(0, len(order), 256):
        pick = order[start:start + 256]
        length = np.array([len(items[i]) for i in pick])
        tall, wide = length.max(), max(1, max(len(stretches[i]) for i in pick))
        a, b = np.zeros((len(pick), tall), np.uint64), np.zeros((len(pick), wide), np.uint64)
        in_a, in_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
        for k, i in enumerate(pick):
            a[k, :len(items[i])], in_a[k, :len(items[i])] = items[i], True
            b[k, :len(stretches[i])], in_b[k, :len(stretches[i])] = stretches[i], True
        above, best = np.zeros((len(pick), wide + 1), np.int32), np.zeros(len(pick), np.int32)
        ramp = np.arange(wide + 1, dtype=np.int32)
        for r in range(tall):
            same = (b == a[:, r:r + 1]) & in_b & in_a[:, r:r + 1]
            row = np.zeros_like(above)
            row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, 1, -1), above[:, 1:] - 1)
            # a gap along the row costs 1 a step: a running maximum of row + step
            row = np.maximum.accumulate(np.maximum(row, 0) + ramp, axis=1) - ramp
            best = np.maximum(best, np.where(in_a[:, r], row.max(axis=1), 0))
            above = row
        out[pick] = best / length
    return out


def _leaks(texts: pa.Array, items: Items) -> list[list[dict]]:
    offsets, tokens = plain_words(texts)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    text, item, diagonal = items.hits(offsets, tokens)
    size = items.size
    # seeds of a copy lie on near diagonals; those more than an item's length apart are another stretch
    stretches, i, n = [], 0, len(text)
    while i < n:
        same = np.searchsorted(text[i:], text[i], side="right") + i
        same = np.searchsorted(item[i:same], item[i], side="right") + i
        j = int(np.searchsorted(diagonal[i:same], diagonal[i] + size[item[i]], side="right") + i)
        reach = items.reach[item[i]]
        low = max(offsets[text[i]], diagonal[i] - reach)
        high = min(offsets[text[i] + 1], diagonal[j - 1] + size[item[i]] + reach)
        stretches.append((int(text[i]), int(item[i]), int(low), int(high)))
        i = j
    for start in range(0, len(stretches), 4096):
        part = stretches[start:start + 4096]
        scores = align([items.words[k] for _, k, _, _ in part], [tokens[a:b] for _, _, a, b in part])
        for (t, k, a, b), score in zip(part, scores):
            if score >= items.threshold[k]:
                found[t].append({"item_id": items.ids[k], "score": float(score), "first_word": a - int(offsets[t]), "words": b - a})
    return found


def word_shares(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> np.ndarray:
    """The share of each of *vocabulary* (sorted hashes) among all words of all documents."""
    def count(batches) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary) + 1, np.int64)
        for piece in words.slices(batches, text):
            _, tokens = plain_words(piece.column(text))
            if len(tokens) and len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
                seen[:-1] += np.bincount(at[vocabulary[at] == tokens], minlength=len(vocabulary))
            seen[-1] += len(tokens)
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(seen[where])], names=["word", "n"])

    counts = docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(len(vocabulary) + 1)
    for row in counts:
        seen[row.word] = row.n
    return seen[:-1] / max(1, seen[-1])


LEAKS = "array<struct<item_id: long, score: double, first_word: long, words: long>>"


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, least_words: int = 5, words_at_once: int = 1 << 22,
) -> Column:
    """A column over ``docs(text)``: the items of ``benchmark(item_id, text)`` found in each text.

    Each entry has the alignment's score (1: every word in order; at least *threshold*),
    and the stretch of the text, in words without bare punctuation.  Every text that
    reaches *threshold* is found, however common the item's words are.  An item found in
    several places appears for each.  A null or empty text has none.  Of items of
    fewer than *least_words* words only exact copies are found, the whole sequence in order:
    edited ones would meet by chance.  Items without words are found nowhere.

    Tasks get all items as arrays, *words_at_once* words of them at most; a larger
    benchmark is searched in that many turns within one pass.  Counting the words of
    the items reads the documents once more.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))).alias("n")).first().n or 0
    turns = -(-size // words_at_once) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(turns))
    groups = []
    for turn in range(turns):
        rows = benchmark.where(part == turn).select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy(
            "item_id", "text").collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows], least_words)
        if items.words:
            items.choose_seeds(word_shares(docs, items.vocabulary), threshold)
            groups.append(spark.sparkContext.broadcast(items))

    @F.arrow_udf(LEAKS)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for piece in words.slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
            found: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            for group in groups:
                for all_, more in zip(found, _leaks(piece.column("text"), group.value)):
                    all_ += more
            out += found
        entry = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())])
        return pa.array(out, pa.list_(entry))

    # evaluated once, also where a later filter repeats it
    return find.asNondeterministic()(F.col("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, score``: each document and item that align, with the best score.

    Rows that repeat a ``doc_id`` are one document; a null id is a document of its own
    name.  Other columns are ignored.
    """
    found = docs.select("doc_id", leaks(docs, benchmark, **options).alias("found"))
    pairs = found.select("doc_id", F.explode("found").alias("leak"))
    return pairs.groupBy("doc_id", F.col("leak.item_id").alias("item_id")).agg(F.max("leak.score").alias("score"))
