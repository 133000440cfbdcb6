"""Importance resampling of documents towards a target: hashed n-gram gains, a perturbed score, the highest scores drawn.

Features are all runs of one to three words; each falls into a bucket by its CRC-32.  A bucket's gain says how much more
frequent it is in the target than in the corpus, a document's weight is the sum of its features' gains, and Gumbel noise
named by the document turns "the highest scores" into a draw without replacement in proportion to the weights.

The boundary of the draw is found by quickselect over the stored scores: random pivot keys among the rows still in
question, exact counts of rows before and at each of them, and on with the interval that holds the wanted rank.  Only
the rows up to the boundary are sorted and numbered, in as many ranges as there are tasks.

Null and empty texts have no features and weight 0; a null key has the noise of an empty name and comes last among equal
scores; repeated rows are scored and drawn as rows of their own (of copies at the boundary as many are drawn as are left
to draw); further columns are ignored; an empty table gives no rows; an empty target makes every gain that of a target
without counts.  Texts and words of any length count whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.blocks import Codes
from trailmark.llm.common import stored

BUCKETS, LONGEST_RUN, LEAST_WORDS, SEED = 10_000, 3, 20, "42"
#: Pivots of a round of the selection.
PIVOTS = 16
#: Distinct words a task remembers before it starts anew.
REMEMBERED = 400_000
#: Words that are worked on at a time, the last text whole.
RUN_WORDS = 300_000
#: Bytes that part words become blanks, A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and all characters beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _appended_zeros() -> np.ndarray:
    """What a CRC-32 becomes by 0 to 63 zero bytes, for each value of each of its four bytes."""
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    shifts = np.empty((64, 4, 256), "u4")
    shifts[0] = np.arange(256, dtype="u4") << (8 * np.arange(4, dtype="u4"))[:, None]
    for i in range(1, 64):
        shifts[i] = (shifts[i - 1] >> 8) ^ table[shifts[i - 1] & 255]
    return shifts.reshape(-1)


_SHIFTS = _appended_zeros()


def _shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = (size << 10).astype("i8")
    made = _SHIFTS[at + (crc & 255)]
    for byte in (1, 2, 3):
        made ^= _SHIFTS[at + 256 * byte + ((crc >> np.uint32(8 * byte)) & 255)]
    return made


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32s of texts followed by so many zero bytes, without the final turn: joined with a CRC-32 of that many bytes
    by exclusive or, they are the CRC-32 of both texts together."""
    if not len(size) or size.max() < 64:
        return _shift(crc, size)
    made = _shift(crc, size & 63)
    for bit in range(6, int(size.max()).bit_length()):
        some = np.flatnonzero((size >> bit) & 1)
        part = made[some]
        for _ in range(1 << (bit - 5)):  # 2^bit zero bytes, 32 at a time
            part = _shift(part, np.full(len(part), 32, "i8"))
        made[some] = part
    return made


class WordTable:
    """CRC-32 of every distinct word, alone and with a blank behind it, and its size."""

    def __init__(self):
        self.codes = Codes()
        self.alone, self.blank, self.sizes = np.empty(0, "u4"), np.empty(0, "u4"), np.empty(0, "i8")

    def look_up(self, found: list[bytes]) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, found), "i8", len(found))
        if new := list(self.codes)[len(self.alone) :] if len(self.codes) > len(self.alone) else []:
            alone = [zlib.crc32(w) for w in new]
            self.blank = np.concatenate([self.blank, np.array([zlib.crc32(b" ", c) for c in alone], "u4")])
            self.alone = np.concatenate([self.alone, np.array(alone, "u4")])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), "i8", len(new))])
        return codes


def features(texts: list[list[bytes]], table: WordTable, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every run of one to three words of the documents."""
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    codes = table.look_up([w for words_ in texts for w in words_])
    alone, blank, size = table.alone[codes], table.blank[codes], table.sizes[codes]
    doc = np.repeat(np.arange(len(texts)), sizes)
    docs, found = [doc], [alone]
    so_far = blank  # CRC-32 of the run so far and a blank, by its first word
    for more in range(1, LONGEST_RUN):
        n = max(0, len(doc) - more)
        here = np.flatnonzero(doc[:n] == doc[more:])
        last = here + more
        docs.append(doc[here])
        found.append(shifted(so_far[here], size[last]) ^ alone[last])
        if more + 1 < LONGEST_RUN:
            longer = np.zeros(len(doc), "u4")
            longer[here] = shifted(so_far[here], size[last] + 1) ^ blank[last]
            so_far = longer
    return np.concatenate(docs), (np.concatenate(found) % np.uint32(buckets)).astype("i8")


def _runs(batches: Iterator[pa.RecordBatch], column: int, most: int = RUN_WORDS) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Batches cut into runs of bounded size, the last text whole, with the words of their texts."""
    for batch in batches:
        run, first, size = [], 0, 0
        for i, cell in enumerate(batch.column(column)):
            run.append(words(cell.as_py() or ""))
            size += len(run[-1])
            if size >= most:
                yield batch.slice(first, len(run)), run
                run, first, size = [], i + 1, 0
        if run:
            yield batch.slice(first, len(run)), run


def _tables() -> Iterator[WordTable]:
    """The same table again and again, a new one when it has grown too large."""
    table = WordTable()
    while True:
        if len(table.codes) > REMEMBERED:
            table = WordTable()
        yield table


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: one row a task and bucket, one row a bucket to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, "i8")
        for (_, run), table in zip(_runs(batches, 0), _tables(), strict=False):
            total += np.bincount(features(run, table)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype("i4")), "n": pa.array(total[some])})

    made = np.zeros(BUCKETS, "i8")
    rows = docs.select(text).mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in rows.collect():
        made[row.bucket] = row.n
    return made


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    ratio = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], "i8")


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document; the gains go to the tasks, a number a bucket."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch, run), table in zip(_runs(batches, 1), _tables(), strict=False):
            doc, bucket = features(run, table)
            n_words = np.fromiter(map(len, run), "i8", len(run))
            weight = np.zeros(len(run), "i8")
            np.add.at(weight, doc, gain[bucket])
            cells = {"n_words": n_words, "n_features": np.bincount(doc, minlength=len(run)), "weight": weight}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {n: pa.array(c, pa.int64()) for n, c in cells.items()})

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(weighed, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column) -> Column:
    """Thousandths of Gumbel noise named by the document, rounded down."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: The order of the draw: high scores, then small ids, rows without an id last.
_KEY = ["score", "nameless", "id"]


def _keys() -> list[Column]:
    return [F.col("score"), F.col("doc_id").isNull().cast("int").alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id")]


def _before(key: tuple[int, int, int]) -> Column:
    """Whether a row comes before a key."""
    score, nameless, one = key
    tie = (F.col("nameless") < nameless) | ((F.col("nameless") == nameless) & (F.col("id") < one))
    return (F.col("score") > score) | ((F.col("score") == score) & tie)


def _at(key: tuple[int, int, int]) -> Column:
    score, nameless, one = key
    return (F.col("score") == score) & (F.col("nameless") == nameless) & (F.col("id") == one)


def key_of_rank(rows: DataFrame, k: int) -> tuple[int, int, int] | None:
    """The key of the k-th of the rows in the order of the draw, by quickselect; None if there is no such row.

    A round is two passes without shuffle over the rows still in question: the rows with the least hashes, one a seed,
    are the pivots, then rows before and at each pivot are counted.  All copies of a key go to the same side.
    """
    rows = rows.select(*_keys())
    low, high, wanted, turn = None, None, k, 0
    while True:
        asked = rows
        if low is not None:
            asked = asked.where((F.col("score") <= low[0]) & ~_before(low) & ~_at(low))
        if high is not None:
            asked = asked.where((F.col("score") >= high[0]) & _before(high))
        drawn = [F.min_by(F.struct(*_KEY), F.xxhash64(*_KEY, F.lit(turn * PIVOTS + i))).alias(f"p{i}") for i in range(PIVOTS)]
        row = asked.agg(*drawn).first()
        pivots = sorted({tuple(p) for p in row if p is not None}, key=lambda p: (-p[0], p[1], p[2]))
        if not pivots or wanted < 1:
            return None
        counted = [c for i, p in enumerate(pivots) for c in (F.count_if(_before(p)).alias(f"b{i}"), F.count_if(_at(p)).alias(f"e{i}"))]
        n = asked.agg(*counted, F.count("*").alias("n")).first()
        if wanted > n["n"]:
            return None
        start = low
        for i, pivot in enumerate(pivots):
            if wanted <= n[f"b{i}"]:
                high = pivot
                break
            if wanted <= n[f"b{i}"] + n[f"e{i}"]:
                return pivot
            low = pivot
        if low is not start:
            i = pivots.index(low)
            wanted -= n[f"b{i}"] + n[f"e{i}"]
        turn += 1


def ranked(winners: DataFrame) -> DataFrame:
    """Rows with their number in the order of the draw: sorted in ranges, numbered by range and place."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    ordered = winners.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    kept = stored(ordered.withColumns({"range": F.shiftright(number, 33), "at": number.bitwiseAND((1 << 33) - 1)}), "winners")
    sizes = {row["range"]: row["n"] for row in kept.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row a task
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    first = winners.sparkSession.createDataFrame(starts, "range bigint, first bigint")
    numbered = kept.join(F.broadcast(first), "range")
    return numbered.withColumn("rank", F.col("first") + F.col("at") + 1).drop("range", "at", "first")


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document, stored."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    return stored(weights(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scores")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, for those drawn, rank.

    Drawn are floor(percent / 100 * N) of the N documents with at least ``least_words`` words.
    """
    rows = scored(docs, target, key, text)
    able = rows.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    last = key_of_rank(able, k)
    if last is None:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    keyed = rows.withColumns({"nameless": _keys()[1], "id": _keys()[2]})
    inside = (F.col("n_words") >= least_words) & (_before(last) | _at(last))
    drawn = ranked(keyed.where(inside).select(*columns))
    rank = F.when(F.col("rank") <= k, F.col("rank")).alias("rank")
    rest = keyed.where(~inside).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.select(*columns, rank).unionByName(rest)


def sampled(docs: DataFrame, drawn: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose id was drawn, all their columns kept."""
    chosen = drawn.where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(chosen, docs[key].cast("bigint") == F.col("drawn_id"), "left_semi")
