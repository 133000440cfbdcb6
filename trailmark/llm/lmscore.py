"""LM scoring with a hashed maximum-entropy model.

Every word falls into one of ``SLOTS`` slots by hash; a slot is a member of a class.  The model is
P(word | history) = P(class | history) P(member | class, history) P(word | slot); the last factor is counted,
(c + 1) / (N of slot + V of slot + 1), the first two are softmax models over hashed features of the history: the word
before, the two words before (n-grams), and the words two and three back (skips).

Training updates the weights from all training documents, distributed: the biases from the slot counts, one gradient
over all training tokens from there, and one more gradient for each of ``shares`` disjoint shares that together are all
training documents (by hash), each task summing its blocks and the sums meeting in a tree of bounded fan-in.  Steps are
scaled by expected feature counts.  Gradients and scores go over blocks of texts in numpy, in batches that fit a core's cache.

The base score is the unigram score with add-one smoothing, from exact counts of the whole training corpus.
Words are split at ASCII white space, A-Z in lower case; every text ends with one end token, so null and empty texts
have one token.  A null id is not held out; repeated rows are scored and learned from each; extra columns are ignored;
an empty table gives no rows; without training texts all counts are 0 and the model is uniform over slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.blocks import Block, blocks, by_word, with_answers, word_hashes
from trailmark.llm.common import pack, stored, unpack

CLASSES = MEMBERS = 32
SLOTS = CLASSES * MEMBERS
#: Hash buckets of one kind of feature, kinds of features, buckets in all.
BUCKETS, KINDS = 2048, 4
ROWS = BUCKETS * KINDS
END = b"\n"
#: Sums that meet in one group of the tree, cells of a chunk of the sum, tokens of a batch.
FAN_IN, CHUNK, BATCH = 64, 1 << 16, 1 << 14
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def split_lower(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


@dataclass
class Model:
    """Biases and hashed weights of the class and the member factor."""

    class_bias: np.ndarray
    member_bias: np.ndarray
    class_weights: np.ndarray
    member_weights: np.ndarray

    @classmethod
    def from_counts(cls, slot_counts: np.ndarray) -> Model:
        """Biases at their optimum for the slot counts, all weights zero."""
        table = slot_counts.reshape(CLASSES, MEMBERS).astype("f8")
        by_class = table.sum(1)
        return cls(
            np.log((by_class + 1) / (by_class.sum() + CLASSES)).astype("f4"),
            np.log((table + 1) / (by_class[:, None] + MEMBERS)).astype("f4"),
            np.zeros((ROWS, CLASSES), "f4"),
            np.zeros((ROWS, MEMBERS), "f4"),
        )

    def stepped(self, sums: np.ndarray, rate: float, damping: float) -> Model:
        """One update from summed gradients and expected counts."""
        g = sums.reshape(4, ROWS, CLASSES)
        step = lambda gradient, expected: (rate * gradient / (expected + damping)).astype("f4")
        return Model(self.class_bias, self.member_bias, self.class_weights + step(g[0], g[1]), self.member_weights + step(g[2], g[3]))


def features(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bucket rows (tokens x kinds) of the history of each token."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(starts, sizes)
    back = []
    for k in (1, 2, 3):
        h = np.empty(n, "u8")
        h[:k], h[k:] = 0, hashes[:-k] if n > k else hashes[:0]
        h[place < k] = k
        back.append(h)
    factor = np.uint64(0x9E3779B97F4A7C15)
    kinds = (back[0], back[0] * factor + back[1], back[1], back[2])
    out = np.empty((n, KINDS), "i4")
    for i, h in enumerate(kinds):
        h = (h ^ (h >> np.uint64(29))) * factor
        out[:, i] = (h >> np.uint64(40)) % np.uint64(BUCKETS) + np.uint64(i * BUCKETS)
    return out


def _member_rows(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Buckets of the history together with the class, within the buckets of the same kind."""
    kind = rows // BUCKETS
    return kind * BUCKETS + (rows % BUCKETS * 31 + classes[:, None] * 677) % BUCKETS


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities, in place of the logits."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def _logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A row for each class (or member), a column for each token; ``bias`` has a row for each token or one for all."""
    out = weights.take(rows[:, 0], axis=0)
    for k in range(1, KINDS):
        out += weights.take(rows[:, k], axis=0)
    out += bias
    return np.ascontiguousarray(out.T)


def log_slots(model: Model, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(slot | history) for each token."""
    out = np.empty(len(slots), "f8")
    for a in range(0, len(slots), BATCH):
        s, r = slots[a : a + BATCH], rows[a : a + BATCH]
        c, m, at = s // MEMBERS, s % MEMBERS, np.arange(len(s))
        one = _logits(model.class_bias, model.class_weights, r)
        two = _logits(model.member_bias[c], model.member_weights, _member_rows(r, c))
        out[a : a + BATCH] = one[c, at] - _log_total(one) + two[m, at] - _log_total(two)
    return out


def _log_total(logits: np.ndarray) -> np.ndarray:
    top = logits.max(0)
    return top + np.log(np.exp(logits - top).sum(0))


def _joint(buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Tokens by bucket of one kind and value (class or member)."""
    return np.bincount(buckets * CLASSES + values, minlength=BUCKETS * CLASSES).reshape(BUCKETS, CLASSES)


def gradient(model: Model, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Gradient and expected counts of both factors at the model, flat."""
    seen, expected = np.zeros((2, KINDS, BUCKETS, CLASSES)), np.zeros((2, KINDS, CLASSES, BUCKETS))
    for a in range(0, len(slots), BATCH):
        s, r = slots[a : a + BATCH], rows[a : a + BATCH]
        c, m = s // MEMBERS, s % MEMBERS
        mr = _member_rows(r, c)
        p = _softmax(_logits(model.class_bias, model.class_weights, r))
        q = _softmax(_logits(model.member_bias[c], model.member_weights, mr))
        for factor, kind_rows, values, chances in ((0, r, c, p), (1, mr, m, q)):
            for k in range(KINDS):
                buckets = kind_rows[:, k].astype("i8") % BUCKETS
                seen[factor, k] += _joint(buckets, values)
                for j in range(CLASSES):
                    expected[factor, k, j] += np.bincount(buckets, chances[j], BUCKETS)
    expected = expected.transpose(0, 1, 3, 2)
    return np.stack([seen - expected, expected], axis=1).ravel()


def bias_gradient(model: Model, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same at a model without weights, where what is expected follows from counts alone."""
    p, q = np.exp(model.class_bias.astype("f8")), np.exp(model.member_bias.astype("f8"))
    p, q = p / p.sum(), q / q.sum(1, keepdims=True)
    counts = np.zeros((3, KINDS, BUCKETS, CLASSES), "i8")
    for a in range(0, len(slots), BATCH):
        s, r = slots[a : a + BATCH], rows[a : a + BATCH]
        c, m = s // MEMBERS, s % MEMBERS
        mr = _member_rows(r, c)
        for k in range(KINDS):
            buckets, member_buckets = r[:, k].astype("i8") % BUCKETS, mr[:, k].astype("i8") % BUCKETS
            counts[0, k] += _joint(buckets, c)
            counts[1, k] += _joint(member_buckets, m)
            counts[2, k] += _joint(member_buckets, c)
    by_class, by_member = counts[0].sum(2, keepdims=True) * p, counts[2] @ q
    return np.concatenate([counts[0] - by_class, by_class, counts[1] - by_member, by_member], axis=None)


def _summed(made: DataFrame, each, keep) -> np.ndarray:
    """Sum over all blocks of ``each(slots, rows)`` of the documents that ``keep`` chooses."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for row in frame.itertuples():
                block = Block(row)
                chosen = keep(block)
                if chosen.any():
                    tokens = block.hashes()[block.codes[np.repeat(chosen, block.sizes)]]
                    sizes = block.sizes[chosen]
                    rows = features(tokens, np.cumsum(sizes, dtype="i8") - sizes, sizes)
                    own = each((tokens % np.uint64(SLOTS)).astype("i8"), rows)
                    total = own if total is None else total + own
        if total is not None:
            parts = [pack(total[a : a + CHUNK].astype("f4")) for a in range(0, len(total), CHUNK)]
            task = TaskContext.get().partitionId()
            yield pd.DataFrame({"chunk": range(len(parts)), "task": [task] * len(parts), "sums": parts})

    schema = "chunk int, task int, sums binary"
    level, last = made.mapInPandas(partial, schema), None

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack(b, "f4").astype("f8") for b in frame.sums)
        return pd.DataFrame({"chunk": frame.chunk[:1], "task": frame.task[:1] // FAN_IN, "sums": [pack(total.astype("f4"))]})

    while last != 0:
        level = stored(level.groupBy("chunk", F.floor(F.col("task") / FAN_IN)).applyInPandas(met, schema), "gradient")
        last = level.agg(F.max("task")).first()[0] or 0
    rows = level.orderBy("chunk").collect()  # as large as the model
    return np.concatenate([unpack(r.sums, "f4").astype("f8") for r in rows]) if rows else np.zeros(4 * ROWS * CLASSES)


def _share(block: Block, share: int, shares: int) -> np.ndarray:
    """Training documents of one share, by hash of the id."""
    ids = np.array([0 if i is None else i for i in block.ids], "i8").astype("u8")
    mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return block.flags & (mixed % np.uint64(shares) == share)


def train(made: DataFrame, slot_counts: np.ndarray, shares: int = 8, rate: float = 0.25, damping: float = 400.0) -> Model:
    """The model after one gradient over all training tokens and one for each of the ``shares`` they are dealt to."""
    model = Model.from_counts(slot_counts)
    model = model.stepped(_summed(made, lambda s, r, m=model: bias_gradient(m, s, r), lambda b: b.flags), rate, damping)
    for u in range(shares):
        keep = lambda b, u=u: _share(b, u, shares)
        model = model.stepped(_summed(made, lambda s, r, m=model: gradient(m, s, r), keep), rate, damping / shares)
    return model


def _counts(found: list[bytes], uses: list[np.ndarray], payloads: list) -> np.ndarray:
    total = np.zeros(len(found), "i8")
    for use, counts in zip(uses, payloads, strict=True):
        np.add.at(total, use, unpack(counts, "i8"))
    return total


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base score and model score of every document, trained on those that are not held out."""
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))
    made = blocks(docs, split_lower, key, text, ~held)

    def sent(block: Block, chosen: np.ndarray) -> bytes:
        own = getattr(block, "counts", None)
        if own is None:
            own = block.counts = np.bincount(block.codes[np.repeat(block.flags, block.sizes)], minlength=len(block.words))
        return pack(own[chosen].astype("i8"))

    def answer(found: list[bytes], uses: list[np.ndarray], payloads: list) -> list[bytes]:
        total = _counts(found, uses, payloads)
        return [pack(total[use]) for use in uses]

    def slot_totals(found: list[bytes], uses: list[np.ndarray], payloads: list) -> bytes:
        total = _counts(found, uses, payloads)
        slots = (word_hashes(found) % np.uint64(SLOTS)).astype("i8")
        return pack(np.concatenate([np.bincount(slots, w, minlength=SLOTS).astype("i8") for w in (total, total > 0)]))

    counted = stored(by_word(made, answer, sent, slot_totals), "word-counts")

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob in frame.answer:
                n, v = np.split(unpack(blob, "i8"), 2)
                yield pd.DataFrame({"slot": np.arange(SLOTS), "n": n, "v": v})

    slots = counted.where("block is null").mapInPandas(opened, "slot int, n bigint, v bigint")
    slots = {r.slot: (r.n, r.v) for r in slots.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}  # as many as slots
    slot_n, slot_v = (np.array([slots.get(i, (0, 0))[j] for i in range(SLOTS)], "i8") for j in (0, 1))
    model = train(made, slot_n)
    n, v = int(slot_n.sum()), int(slot_v.sum())

    def finish(block: Block, blobs: list[bytes], order: np.ndarray) -> pd.DataFrame:
        c = np.empty(len(order), "i8")
        c[order] = np.concatenate([unpack(b, "i8") for b in blobs]) if blobs else np.empty(0, "i8")
        hashes = block.hashes()
        slot = (hashes % np.uint64(SLOTS)).astype("i8")
        base = np.log10(c + 1.0) - np.log10(n + v + 1.0)
        inside = np.log10(c + 1.0) - np.log10(slot_n[slot] + slot_v[slot] + 1.0)
        codes = block.codes
        found = log_slots(model, slot[codes], features(hashes[codes], block.starts, block.sizes)) / np.log(10) + inside[codes]
        each = lambda values: np.add.reduceat(values, block.starts)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(block.ids, dtype="Int64"),
                "held_out": ~block.flags,
                "n_tokens": block.sizes.astype("i8"),
                "n_known": each((c[codes] > 0).astype("i8")),
                "train_tokens": n,
                "base_score": each(base[codes]),
                "score": each(found),
            }
        )

    return with_answers(made, counted.where("block is not null"), finish, SCORES)
