"""Documents as blocks: each block holds its distinct words once and its texts as positions in that list.

A block is cut from one task's rows and bounded by its number of words, so every later step works on
pieces of bounded size.  What a step needs to know of a word from all of the corpus (a count, its
token ids) goes through ``by_word``: the distinct words of all blocks are dealt out by hash, so one
word meets itself from all blocks in one place; a block sends a word once, however often it occurs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import pack, pack_words, stored, unpack, unpack_words

#: A block is closed at so many words (or what the caller says), distinct words or characters of text, the last text whole.
BLOCK_WORDS, BLOCK_DISTINCT, BLOCK_CHARS = 2_000_000, 1_500_000, 96_000_000
#: Level of compression of texts and words.
LEVEL = 9
BLOCKS = "block bigint, ids binary, named binary, flags binary, sizes binary, codes binary, words binary, parts binary"
ANSWERS = "block bigint, part int, answer binary"

Splitter = Callable[[str], list]


class Codes(defaultdict):
    """Word -> its position in order of first use."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__  # a word not seen yet gets the next number


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes byte plane by byte plane: with frequent words first, the upper planes are nearly all zeros."""
    planes = [pack((codes >> shift).astype("u1"), LEVEL) for shift in (0, 8, 16)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in planes)


def unpack_codes(blob: bytes) -> np.ndarray:
    """The codes of ``pack_codes``."""
    blob, at, codes = bytes(blob), 0, 0
    for shift in (0, 8, 16):
        size = int.from_bytes(blob[at : at + 8], "little")
        codes = codes | (unpack(blob[at + 8 : at + 8 + size], "u1").astype("i4") << shift)
        at += 8 + size
    return codes


class Block:
    """A block row unpacked; ``parts`` has the part that each word is dealt to."""

    def __init__(self, row):
        self.block, self.flags = int(row.block), unpack(row.flags, "?")
        self.ids = [i if known else None for i, known in zip(unpack(row.ids, "i8").tolist(), unpack(row.named, "?").tolist(), strict=True)]
        self.sizes, self.codes = unpack(row.sizes, "i4"), unpack_codes(row.codes)
        self.words = unpack_words(row.words) if hasattr(row, "words") else []
        self.parts = unpack_codes(row.parts)
        self.ends = np.cumsum(self.sizes, dtype="i8")
        self.starts = self.ends - self.sizes

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every distinct word."""
        return word_hashes(self.words)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))


def _rows(batches: Iterator[pa.RecordBatch], split: Splitter, n_parts: int, most_words: int) -> Iterator[pa.RecordBatch]:
    first, count = TaskContext.get().partitionId() << 24, 0
    codes, ids, flags, sizes, parts, n, volume = Codes(), [], [], [], [], 0, 0

    def row():
        kept = [w if isinstance(w, bytes) else w.encode() for w in codes]
        column = np.concatenate(parts) if parts else np.empty(0, "i4")
        order = np.argsort(-np.bincount(column, minlength=len(kept)), kind="stable")
        place = np.empty(len(kept), "i4")
        place[order] = np.arange(len(kept), dtype="i4")
        column, kept = place[column], [kept[i] for i in order.tolist()]
        keys, named = np.array([i or 0 for i in ids], "i8"), np.array([i is not None for i in ids], "?")
        packed = {"ids": pack(keys), "named": pack(named), "flags": pack(np.array(flags, "?")), "sizes": pack(np.array(sizes, "i4"))}
        packed |= {"codes": pack_codes(column), "words": pack_words(kept, LEVEL), "parts": pack_codes(parts_of(word_hashes(kept), n_parts))}
        cells = [pa.array([first + count], pa.int64()), *[pa.array([p], pa.binary()) for p in packed.values()]]
        return pa.RecordBatch.from_arrays(cells, names=["block", *packed])

    for batch in batches:
        for key, flag, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            text = text.as_py() or ""
            found = split(text)
            ids.append(key.as_py())
            flags.append(bool(flag.as_py()))
            sizes.append(len(found))
            parts.append(np.fromiter(map(codes.__getitem__, found), "i4", len(found)))
            n, volume = n + len(found), volume + len(text)
            if n >= most_words or len(codes) >= BLOCK_DISTINCT or volume >= BLOCK_CHARS:
                yield row()
                count += 1
                codes, ids, flags, sizes, parts, n, volume = Codes(), [], [], [], [], 0, 0
    if ids:
        yield row()


def blocks(
    docs: DataFrame,
    split: Splitter,
    key: str = "doc_id",
    text: str = "text",
    flag: Column | None = None,
    most_words: int = BLOCK_WORDS,
    folder: str | None = None,
) -> DataFrame:
    """The documents as stored blocks; ``split`` gives a text's words as str or bytes.

    Words are dealt to as many parts as there are shuffle partitions.  A null text is empty; a null key stays null;
    repeated rows stay repeated.
    """
    flags = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    rows = docs.select(F.col(key).cast("bigint").alias("k"), flags.alias("f"), F.col(text).alias("t"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.mapInArrow(lambda batches: _rows(batches, split, n, most_words), BLOCKS), "blocks", folder)


def parts_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The part each word is dealt to; independent of the low bits that other uses take."""
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype("i4")


def by_word(
    stored_blocks: DataFrame,
    answer: Callable[[list[bytes], list[np.ndarray], list], list[bytes]],
    payload: Callable[[Block, np.ndarray], bytes] | None = None,
    total: Callable[[list[bytes], list[np.ndarray], list], bytes] | None = None,
) -> DataFrame:
    """For each block and part, what ``answer`` says of the block's words in that part.

    ``answer(words, uses, payloads)`` gets the distinct words of a part, for each block the positions
    of its words in that list, and each block's payload; it returns a blob for each block.  ``total``
    gets the same and returns one blob for the part, in a row without block.
    """

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = Block(row)
                for p, chosen in _runs(block.parts):
                    extra = payload(block, chosen) if payload else b""
                    yield pd.DataFrame({"block": [block.block], "part": [p], "words": [pack_words([block.words[i] for i in chosen.tolist()], LEVEL)], "extra": [extra]})

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        codes = Codes()
        uses = []
        for blob in frame.words:
            found = unpack_words(blob)
            uses.append(np.fromiter(map(codes.__getitem__, found), "i4", len(found)))
        blobs = answer(list(codes), uses, list(frame.extra))
        out = pd.DataFrame({"block": frame.block.astype("Int64"), "part": frame.part, "answer": blobs})
        if total:
            one = pd.DataFrame({"block": pd.array([None], "Int64"), "part": frame.part[:1].tolist(), "answer": [total(list(codes), uses, list(frame.extra))]})
            out = pd.concat([out, one])
        return out

    sent = stored_blocks.mapInPandas(dealt, "block bigint, part int, words binary, extra binary")
    return sent.groupBy("part").applyInPandas(met, ANSWERS)


def _runs(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Equal parts with the positions that have them."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for chosen in np.split(order, cuts):
        yield int(part[chosen[0]]), chosen


def with_answers(
    stored_blocks: DataFrame, answers: DataFrame, finish: Callable[[Block, list[bytes], np.ndarray], pd.DataFrame], schema: str
) -> DataFrame:
    """Each block beside the answers to its words.

    ``finish(block, blobs, order)`` makes the rows; the blobs joined answer the words in the given order.  Leave the
    column ``words`` out of the blocks where ``finish`` needs no words.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def beside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in left.itertuples():
            block = Block(row)
            runs = list(_runs(block.parts))
            blob = dict(zip(right.part, right.answer, strict=True))
            order = np.concatenate([chosen for _, chosen in runs]) if runs else np.empty(0, "i8")
            made.append(finish(block, [blob[p] for p, _ in runs], order))
        return pd.concat(made)[names] if made else pd.DataFrame(columns=names)

    return stored_blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(beside, schema)
