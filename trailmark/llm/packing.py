"""Packing of documents into token sequences of a fixed size by best-two-fit.

A sequence is filled greedily with the longest pieces that fit; then its smallest piece gives way to the two unpacked
pieces that fill the widened gap best, if two fit it more tightly.  Pieces of equal length are alike, so the plan needs
only how many pieces there are of each length (never more numbers than a sequence has tokens), and a filling that
repeats is planned once with its number of repeats.  Every piece then finds its place by its rank among the pieces of
its length.  Ranks come from counts by task and length, so no task holds all pieces of a common length.

Null and empty texts are documents of the closing id alone; a text of any length is encoded whole and cut only if it is
longer than a sequence, the rest at its start; repeated rows are documents of their own; a null key stays null; further
columns are ignored; an empty table gives no rows.  Among pieces of one length, which are ties, the order of storage
decides, and no result but the numbers depends on it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm import bpe
from trailmark.llm.common import stored

SEQUENCE_TOKENS, END_ID = 2048, 0
#: Words whose ids a worker remembers, and longest word that is remembered.
REMEMBERED, LONGEST = 800_000, 64
#: New words that are encoded as one text.
TOGETHER = 500
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ˁ", "0-9²³¹¼-¾"
#: Characters whose classes are the ones below in every version of Unicode.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\u02c1\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]*")
_PLAIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)


class Encoder:
    """Ids of texts as little-endian 32-bit integers.

    The ids of short words are remembered.  When there are too many, those that were not met since the last time are
    forgotten.  Words not known yet are encoded many at a time, parted by a token of the vocabulary that no word holds.
    """

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.specials = bpe.specials(path)

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            return _PLAIN_WORDS.findall(text)
        return bpe.split_words(text, self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known.get, self.before.get
        lists, gaps, new = [], [], {}
        for text in texts:
            found = self.split(text)
            ids = list(map(known, found))
            lists.append(ids)
            missing = ids.count(None)
            at = -1
            for _ in range(missing):
                at = ids.index(None, at + 1)
                word = found[at]
                own = before(word)
                if own is not None:
                    ids[at] = self.known[word] = own
                else:
                    gaps.append((ids, at, word))
                    new[word] = None
        made = self._new(list(new))
        for ids, at, word in gaps:
            ids[at] = made[word]
        self.known |= {w: x for w, x in made.items() if len(w) <= LONGEST}
        return [b"".join(ids) for ids in lists]

    def _new(self, found: list[str]) -> dict[str, bytes]:
        """Ids of words."""
        tokenizer, made = bpe._tokenizer(self.path), {}
        alone = [w for w in found if not self.specials or any(s in w for s in self.specials)]
        for word, encoded in zip(alone, tokenizer.encode_batch(alone, add_special_tokens=False), strict=True):
            made[word] = np.array(encoded.ids, "<u4").tobytes()
        rest = [w for w in found if w not in made]
        runs = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        if not runs:
            return made
        mark, cut = self.specials[0], tokenizer.token_to_id(self.specials[0])
        for run, encoded in zip(runs, tokenizer.encode_batch_fast([mark.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == cut)).tolist()
            raw = ids.tobytes()
            made.update(zip(run, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)], strict=True))
        return made


_ENCODERS: dict[str, Encoder] = {}


def _texts(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size, the last text whole, with the place of the first."""
    run, first, size = [], 0, 0
    for i, cell in enumerate(column):
        text = cell.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= most:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all are full but the first."""
    first = n % limit or min(n, limit)
    return [(0, first), *[(at, limit) for at in range(first, n, limit)]] if n else []


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId()
    encoder = _ENCODERS.setdefault(path, Encoder(path))
    seen, tail = [0] * (limit + 1), array("I", [end]).tobytes()
    for batch in batches:
        keys = batch.column(0)
        for first, run in _texts(batch.column(1)):
            rows = []
            for i, ids in enumerate(encoder.encode(run), first):
                ids += tail
                for piece, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((i, piece, start, length, zlib.crc32(own), seen[length], own))
                    seen[length] += 1
            place, piece, start, length, crc, at, own = zip(*rows, strict=True)
            made = {
                "doc_id": keys.take(pa.array(place, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int32()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "chunk": pa.array([chunk] * len(rows), pa.int32()),
                "at": pa.array(at, pa.int64()),
            }
            if with_ids:
                made["ids"] = pa.array([np.frombuffer(x, "<u4").astype("i4") for x in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(made)


def pieces(docs: DataFrame, path: str, limit: int, end: int, with_ids: bool, key: str, text: str) -> DataFrame:
    """Pieces of all documents, stored, with their place among the pieces of their length that a task (chunk) made."""
    schema = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, chunk int, at bigint"
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(lambda b: _pieces(b, path, limit, end, with_ids), schema + ", ids array<int>" * with_ids)
    return stored(made, "pieces")


@dataclass(frozen=True)
class Plan:
    """Fillings: for each length, runs of ranks with the sequence and the offset of the first of them.

    ``keys`` has length * 2^40 + first rank of the run in rising order; ``uses`` pieces of the run go to each sequence.
    """

    keys: np.ndarray
    uses: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        wanted = (length.astype("i8") << 40) + rank
        run = np.searchsorted(self.keys, wanted, "right") - 1
        turn, place = np.divmod(wanted - self.keys[run], self.uses[run])
        return self.sequence[run] + turn, self.offset[run] + place * length


def filling(counts: np.ndarray, limit: int) -> tuple[dict[int, int], int]:
    """One sequence by best-two-fit: pieces used by length, and how often the same filling is the next one again."""
    left, used, gap = counts, {}, limit
    lengths = np.flatnonzero(counts)
    while gap and len(lengths := lengths[lengths <= gap]):
        longest = int(lengths[-1])
        used[longest] = min(gap // longest, int(left[longest]))
        gap -= used[longest] * longest
        lengths = lengths[:-1]
    needed, final = dict(used), dict(used)
    if gap and used:
        smallest = min(used)
        free = left.copy()
        for length, n in used.items():
            free[length] -= n
        pair = best_two(free, smallest, gap + smallest)
        if pair:
            final[smallest] -= 1
            for length in pair:
                needed[length] = needed.get(length, 0) + 1
                final[length] = final.get(length, 0) + 1
    final = {length: n for length, n in final.items() if n}
    times = min(1 + (int(counts[length]) - needed[length]) // n for length, n in final.items())
    return final, times


def best_two(free: np.ndarray, over: int, gap: int) -> tuple[int, int] | None:
    """The two free lengths that fill the gap best and more than ``over``; of equal pairs the one with the longest piece."""
    first = np.flatnonzero(free[: gap + 1])
    if not len(first):
        return None
    below = np.maximum.accumulate(np.where(free[: gap + 1] > 0, np.arange(gap + 1), 0))
    below_itself = np.concatenate([[0], below[:-1]])  # the longest free length that is shorter
    room = np.minimum(gap - first, first)
    second = below[room]
    same = (second == first) & (free[first] < 2)
    second = np.where(same, below_itself[first], second)
    total = np.where(second > 0, first + second, 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(first[best]), int(second[best])) if total[best] > over else None


def plan(counts: np.ndarray, limit: int) -> Plan:
    """Best-two-fit of all pieces, given how many there are of each length (at most ``limit`` numbers).

    Every filling uses up a length, down to less than one more filling needs, so there are few of them however many
    pieces there are.
    """
    counts, taken = counts.astype("i8").copy(), np.zeros(limit + 1, "i8")
    runs, sequence = [], 0
    while counts.any():
        used, times = filling(counts, limit)
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            runs.append(((length << 40) + int(taken[length]), n, sequence, offset))
            taken[length] += n * times
            counts[length] -= n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(runs), "i8").reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(c) for c in table.T), sequence)


def _placed(batches: Iterator[pa.RecordBatch], made: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
        sequence, offset = made.place(length, rank)
        kept = {n: batch.column(n) for n in batch.schema.names if n not in ("length", "rank")}
        yield pa.RecordBatch.from_pydict(kept | {"length": pa.array(length, pa.int64()), "sequence_id": pa.array(sequence), "offset": pa.array(offset)})


def pack(
    docs: DataFrame,
    path: str,
    limit: int = SEQUENCE_TOKENS,
    end: int = END_ID,
    with_ids: bool = False,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with the sequence each goes to and its offset there; ``with_ids`` adds their ids.

    A document is the ids of its text and then ``end``.  Sequences hold at most ``limit`` tokens, without gaps from
    offset 0 on; their numbers run from 0 on.
    """
    made = pieces(docs, path, limit, end, with_ids, key, text)
    counts = stored(made.groupBy("chunk", "length").agg(F.count("*").alias("n")), "piece-counts")
    total = np.zeros(limit + 1, "i8")
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        total[row.length] = row.n
    planned = plan(total, limit)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ids = ["ids"] * with_ids
    ranked = made.join(base, ["chunk", "length"]).select(
        "doc_id", "piece", "start", "ids_crc32", *ids, "length", (F.col("base") + F.col("at")).alias("rank")
    )
    schema = "doc_id bigint, piece int, start bigint, ids_crc32 bigint, " + "ids array<int>, " * with_ids
    placed = ranked.mapInArrow(lambda b: _placed(b, planned), schema + "length bigint, sequence_id bigint, offset bigint")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids): the sequences themselves, from pieces that were packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids")
    )
