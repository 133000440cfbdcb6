"""n-gram Jaccard join with set-relation skipping.

A document's set are its distinct shingles of ``width`` words (A-Z lower-cased; a shorter text is one shingle; a text
without words has none and links with nothing).  Two documents link when their sets' similarity is at least
``percent`` / 100; a document's component is the smallest id reachable over links.

Method, exact and without all pairs of a group:
* Equal sets are one set from here on.
* Shingles are ordered by the power of two of their number of sets, then by hash.  Only a set's first shingles, without
  those no other set has, enter the index lists: sets that link share one of them.
* Every set is compared with one hub: of the sets whose shingles are the most common in a list, that which it shares
  most lists with.  Sets that link with their hub form its family; the overlap with the hub is kept.
* Lists hold families instead of sets, in blocks by position; blocks whose positions and sizes cannot reach the overlap
  are skipped.  For families that meet, the hubs are compared.  If they link, their members are connected.  If not, and
  nothing else has connected them, the answers of the members are derived from those of the hubs: with b(x) the
  shingles of x that its hub lacks and some other set has, overlap(x, w) <= overlap(hubs) + b(x) + b(w), and less where
  one of them is a hub.  Only members whose bound still reaches the limit are compared.

Shingles are kept as 48 of 64 hash bits, so a pair's overlap is wrong with a chance of about n^2 / 2^48.
Null ids stay null and never name a component; rows that come twice come out twice; a null text has no set; extra
columns are ignored; an empty table gives no rows.  Hot lists are cut into bounded blocks, equal rows are combined before
each shuffle, and nothing that grows with the data goes to the driver or is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.blocks import BLOCK_WORDS, Block, blocks
from trailmark.llm.common import pack, stored, unpack
from trailmark.llm.components import components
from trailmark.sources.folders import remove
from trailmark.sources.workdir import new_folder

#: Bits of a shingle that are kept, and by which its sets are counted.
KEPT_BITS, COUNT_BITS = 48, 44
#: Entries of a block of an index list.
BLOCK_ENTRIES = 512
#: Pairs of a family that are tested before the pairs that are then connected are dropped.
PICKS = 6
_LOW = (1 << 40) - 1
_SETS = (
    "block bigint, doc_id bigint, set_id bigint, n bigint, first boolean, single bigint, depth bigint, tokens array<bigint>, places array<int>, elements binary"
)


def split_lower(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_sets(block: Block, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (64 bits) of each document of the block."""
    hashes, factor = block.hashes()[block.codes], np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(hashes) - width + 1), "u8")
    for i in range(width):
        rolled = rolled * factor + hashes[i : i + len(rolled)]
    rolled, out = _mixed(rolled), []
    for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), seed=b - a)], "u8"))
        else:
            out.append(np.empty(0, "u8"))
    return out


def _own_sets(block: Block, width: int) -> tuple[list[tuple[int, int, bool]], list[np.ndarray]]:
    """For each document (set id, size, first of its set in the block), and the kept bits of each first set."""
    seen, rows, firsts = set(), [], []
    for s in shingle_sets(block, width):
        name = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype("i8"))
        rows.append((name, len(s), len(s) > 0 and name not in seen))
        if rows[-1][2]:
            seen.add(name)
            firsts.append(s >> np.uint64(64 - KEPT_BITS))
    return rows, firsts


def _counted_keys(firsts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each shingle's key in them, and the number of sets that have each."""
    flat = np.concatenate(firsts) if firsts else np.empty(0, "u8")
    return np.unique(flat >> np.uint64(KEPT_BITS - COUNT_BITS), return_inverse=True, return_counts=True)


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Ends of the n equal ranges of key space in the sorted keys."""
    return np.searchsorted(keys, np.array([((i + 1) << COUNT_BITS) // n for i in range(n)], "u8"))


def _pack_sorted(keys: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = [pack((gaps >> np.uint64(8 * i)).astype("u1")) for i in range(6)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in planes)


def _unpack_sorted(blob: bytes) -> np.ndarray:
    blob, at, gaps = bytes(blob), 0, np.uint64(0)
    for i in range(6):
        size = int.from_bytes(blob[at : at + 8], "little")
        gaps = gaps + (unpack(blob[at + 8 : at + 8 + size], "u1").astype("u8") << np.uint64(8 * i))
        at += 8 + size
    return np.cumsum(gaps, dtype="u8")


def _classes(stored_blocks: DataFrame, width: int, n: int) -> DataFrame:
    """(block, part, classes): for the sorted keys of a block in a range, the power of two of their number of sets."""

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                keys, _, counts = _counted_keys(_own_sets(Block(row), width)[1])
                ends = _cuts(keys, n)
                for part, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    if b > a:
                        yield pd.DataFrame({"block": [row.block], "part": [part], "keys": [_pack_sorted(keys[a:b])], "counts": [pack(counts[a:b].astype("u4"))]})

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        each = [_unpack_sorted(k) for k in frame["keys"]]
        _, back = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.bincount(back, np.concatenate([unpack(c, "u4") for c in frame["counts"]]))
        classes = np.floor(np.log2(counts)).astype("u1")[back]
        ends = np.cumsum([len(k) for k in each])
        return pd.DataFrame({"block": frame.block, "part": frame.part, "classes": [pack(c) for c in np.split(classes, ends[:-1])]})

    sent = stored_blocks.mapInPandas(dealt, "block bigint, part int, keys binary, counts binary")
    return sent.groupBy("part").applyInPandas(met, "block bigint, part int, classes binary")


def _six(elements: np.ndarray) -> bytes:
    return np.ascontiguousarray(elements.astype("<u8")).view("u1").reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, "u1").reshape(-1, 6)
    wide = np.zeros((len(raw), 8), "u1")
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


def set_rows(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A stored row for each document: its set, and for the first of a set in a block the shared first shingles."""
    folder = new_folder(docs.sparkSession, "blocks")
    made = blocks(docs, split_lower, key, text, most_words=block_words, folder=folder)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in _SETS.split(", ")]

    def beside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        classes = {p: c for p, c in zip(right.part, right.classes, strict=True)}
        flat = np.concatenate([unpack(classes[p], "u1") for p in sorted(classes)] or [np.empty(0, "u1")])
        for row in left.itertuples():
            block = Block(row)
            rows, firsts = _own_sets(block, width)
            _, back, _ = _counted_keys(firsts)
            ranks, at, todo = flat[back], 0, iter(firsts)
            for doc, (name, size, first) in zip(block.ids, rows, strict=True):
                single, depth, tokens, places, elements = 0, 0, [], [], None
                if first:
                    own = next(todo)
                    rank = ranks[at : at + len(own)]
                    at += len(own)
                    order = np.lexsort((own, rank))
                    single, depth = int((rank == 0).sum()), int(1000 * (63 - rank.mean()))
                    prefix = size - -(-percent * size // 100) + 1
                    shared = order[single:prefix]
                    tokens, places = own[shared].astype("i8"), np.arange(single, single + len(shared), dtype="i4")
                    elements = _six(own) if len(shared) else None
                out.append((block.block, doc, name, size, first, single, depth, tokens, places, elements))
        cells = dict(zip(names, zip(*out, strict=True), strict=True)) if out else {c: () for c in names}
        return pd.DataFrame({c: pd.Series(list(v), dtype="Int64" if c == "doc_id" else None) for c, v in cells.items()})

    rows = made.groupBy("block").cogroup(_classes(made, width, n).groupBy("block")).applyInPandas(beside, _SETS)
    out = stored(rows, "sets")
    remove(docs.sparkSession, folder)  # all that was read from the blocks is stored
    return out


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, o): size of the intersection of the sets of each pair."""
    one = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("left"))
    two = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("right"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            o = []
            for x, y in zip(frame.left, frame.right, strict=True):
                x, y = _from_six(x), _from_six(y)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                o.append(int((y[at] == x).sum()))
            yield frame[["a", "b"]].assign(o=np.array(o, "i8"))

    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return joined.mapInPandas(counted, "a bigint, b bigint, o bigint")


def linked_components(rows: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all sets that link with another one; ``rows`` from ``set_rows``."""
    firsts = rows.where("first and size(tokens) > 0")
    one = firsts.groupBy("set_id").agg(F.min("block").alias("block"))
    sets = firsts.join(one, ["set_id", "block"], "left_semi")
    sets = stored(sets.select("set_id", "n", "single", "depth", "tokens", "places", "elements"), "index-sets")
    size = sets.select("set_id", "n")
    entry = F.explode(F.arrays_zip("tokens", "places")).alias("e")
    entries = sets.select("set_id", "n", "single", "depth", entry).select(
        F.col("e.tokens").alias("token"), "set_id", "n", "single", "depth", F.col("e.places").alias("place")
    )

    # every set and its hub
    rank = F.col("depth") * (_LOW + 1) + F.col("set_id").bitwiseAND(F.lit(_LOW))
    lists = entries.groupBy("token").agg(
        F.count("*").alias("length"), F.min_by("set_id", rank).alias("hub"), F.min_by("n", rank).alias("hub_n")
    )
    near = entries.join(lists.where("length > 1"), "token").where(
        (F.col("hub") != F.col("set_id")) & (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
    )
    shared = near.groupBy("set_id", "hub").agg(F.count("*").alias("shared"))
    order = F.col("shared") * (_LOW + 1) + F.col("hub").bitwiseAND(F.lit(_LOW))
    hubs = shared.groupBy(F.col("set_id").alias("a")).agg(F.max_by("hub", order).alias("b"))
    first = stored(_sized(overlaps(hubs, sets), size), "hub-overlaps")
    linked = first.where(_links(percent))

    # families: sets that link with their hub and are not hubs themselves
    heads = linked.select(F.col("b").alias("a")).distinct()
    family = linked.join(heads, "a", "left_anti").select(F.col("a").alias("set_id"), F.col("b").alias("family"), "o")
    member = sets.select("set_id", "n", (F.col("n") - F.col("single")).alias("shared")).join(family, "set_id", "left").select(
        "set_id", "n", "shared", F.coalesce("family", "set_id").alias("family"), F.coalesce("o", "n").alias("with_hub")
    )
    member = stored(member.withColumn("beyond", F.greatest(F.col("shared") - F.col("with_hub"), F.lit(0))), "members")
    placed = entries.select("token", "set_id", "n", "place").join(member.select("set_id", "family"), "set_id")

    # lists of families, in blocks by position
    grouped = placed.groupBy("token", "family").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("rest")
    )
    lengths = grouped.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    opened = grouped.join(lengths, "token").withColumn("part", F.pmod(F.xxhash64("family"), F.ceil(F.col("length") / BLOCK_ENTRIES)))
    cut = opened.groupBy("token", F.floor(F.col("rest") / 32).alias("band"), "part").agg(
        F.collect_list(F.struct("family", "low", "high", "rest")).alias("found"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest")
    )
    left, right = (cut.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "part", "found", "low", "high", "rest")]) for s in "lr")
    reach = _reach("low_l", "high_l", "rest_l", "low_r", "high_r", "rest_r", percent)
    met = left.join(right, "token").where("(band_l, part_l) <= (band_r, part_r)").where(reach)
    # entries of the left block beside those of the right one that they can reach, each pair once
    met = met.select(F.expr("band_l = band_r and part_l = part_r").alias("same"), F.explode("found_l").alias("x"), "found_r")
    fits = _reach("x.low", "x.high", "x.rest", "y.low", "y.high", "y.rest", percent, in_block=True)
    met = met.select("x", F.explode(F.filter("found_r", fits)).alias("y"))
    pairs = met.select(F.least("x.family", "y.family").alias("a"), F.greatest("x.family", "y.family").alias("b")).distinct()
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(pairs.join(known, ["a", "b"], "left_anti"), "family-pairs")
    second = between_families(pairs, linked.join(heads, "a", "left_semi").select("a", "b"), sets, size, percent)

    # members of families that nothing has connected yet
    found = linked.select("a", "b").unionByName(second.where(_links(percent)).select("a", "b"))
    roots = stored(components(found), "roots")
    apart = second.unionByName(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o", "n_a", "n_b")).where(~_links(percent))
    is_head = F.col("set_id") == F.col("family")
    heads = member.groupBy("family").agg(
        F.max("beyond").alias("reach"), F.min("n").alias("low"), F.max(F.when(is_head, 0).otherwise(1)).alias("more"), F.max(F.when(is_head, F.col("shared"))).alias("common")
    )
    some = apart.select("a", "b", "o").distinct()
    for s in "ab":
        some = some.join(heads.select(F.col("family").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("reach", "low", "more", "common")]), s)
        some = some.join(roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")), s, "left")
    some = some.where("more_a + more_b > 0 and coalesce(root_a, a) <> coalesce(root_b, b)")
    sides = [f"{c}_{s}" for c in ("reach", "low", "more", "common") for s in "ab"]
    some = stored(some.select("a", "b", "o", *sides), "families-apart")
    enough = lambda most, n, m: (100 + percent) * most >= percent * (n + m)

    def reaching(s: str, t: str) -> DataFrame:
        """Members of one side that may reach any member of the other."""
        own = member.select(*[F.col(c).alias(f"{c}_{s}") for c in ("set_id", "n", "shared", "with_hub", "beyond")], F.col("family").alias(s))
        alone = F.least("o", f"with_hub_{s}") + F.least(F.col(f"beyond_{s}"), F.greatest(F.col(f"common_{t}") - F.col("o"), F.lit(0)))
        most = F.when(F.col(f"more_{t}") == 0, alone).otherwise(F.col("o") + F.col(f"beyond_{s}") + F.col(f"reach_{t}"))
        return own.join(some, s).where(enough(F.least(most, f"shared_{s}"), F.col(f"n_{s}"), F.col(f"low_{t}"))).drop(*sides)

    inner = reaching("a", "b").join(reaching("b", "a").drop("o"), ["a", "b"])
    head_a, head_b = F.col("set_id_a") == F.col("a"), F.col("set_id_b") == F.col("b")
    one_hub = lambda x, h: F.least("o", f"with_hub_{x}") + F.least(F.col(f"beyond_{x}"), F.greatest(F.col(f"shared_{h}") - F.col("o"), F.lit(0)))
    bound = F.when(head_a, one_hub("b", "a")).when(head_b, one_hub("a", "b")).otherwise(F.col("o") + F.col("beyond_a") + F.col("beyond_b"))
    most = F.least(bound, F.col("shared_a"), F.col("shared_b"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    inner = inner.where(enough(most, F.col("n_a"), F.col("n_b")) & fits & ~(head_a & head_b))
    inner = inner.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).distinct()
    third = stored(_sized(overlaps(inner, sets), size).where(_links(percent)).select("a", "b"), "member-links")
    if third.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(third))


def between_families(pairs: DataFrame, links: DataFrame, sets: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """(a, b, o, n_a, n_b) of the pairs of families, but for those that links of others connect anyway.

    Up to ``PICKS`` pairs of every family, in an order by hash, are tested first; what their links connect is dropped, and
    all that is left is tested.  In a large group of similar families few links connect all, and most of the pairs among
    them, which grow with the square of the group, need no test.  Pairs that are not connected are all tested.
    """
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    order = Window.partitionBy("node").orderBy(F.xxhash64("a", "b"), "a", "b")
    picked = sides.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PICKS).select("a", "b").distinct()
    first = stored(_sized(overlaps(picked, sets), size), "family-overlaps")
    links = links.unionByName(first.where(_links(percent)).select("a", "b"))
    rest = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")
    return first.unionByName(stored(_sized(overlaps(_apart(rest, links), sets), size), "family-overlaps"))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs that the links do not connect."""
    roots = stored(components(links), "family-roots")
    for s in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")), s, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _sized(found: DataFrame, size: DataFrame) -> DataFrame:
    found = found.join(size.select(F.col("set_id").alias("a"), F.col("n").alias("n_a")), "a")
    return found.join(size.select(F.col("set_id").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "o", "n_a", "n_b")


def _links(percent: int):
    return F.col("o") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("o")) * percent


def _reach(low_l, high_l, rest_l, low_r, high_r, rest_r, percent: int, in_block: bool = False):
    """Whether sets of these sizes, with so many shingles from the shared one on, can overlap enough.

    ``in_block`` gives a test of an entry y of the right block beside the entry x of the left one.
    """
    if in_block:

        def fits(y):
            place = {"y.low": y["low"], "y.high": y["high"], "y.rest": y["rest"]}
            apart = F.when(F.col("same"), F.col("x.family") < y["family"]).otherwise(F.col("x.family") != y["family"])
            return apart & _reach(low_l, high_l, rest_l, *(place[n] for n in (low_r, high_r, rest_r)), percent)

        return fits
    c = lambda x: F.col(x) if isinstance(x, str) else x
    enough = F.least(c(rest_l), c(rest_r)) * (100 + percent) >= (c(low_l) + c(low_r)) * percent
    return enough & (c(high_l) * 100 >= c(low_r) * percent) & (c(high_r) * 100 >= c(low_l) * percent)


def join(
    docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, set_id, n_shingles, component_id) of every document; blocks of fewer words need less memory and more disk."""
    rows = set_rows(docs, width, percent, key, text, block_words)
    roots = linked_components(rows, percent)
    own = rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    own = own.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    own = stored(own, "set-roots")
    least = own.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = own.join(least, "root").select("set_id", "component_id")
    full = rows.where("n > 0").select("doc_id", "set_id", "n").join(named, "set_id", "left")
    full = full.select("doc_id", "set_id", F.col("n").alias("n_shingles"), "component_id")
    bare = rows.where("n = 0").select("doc_id", F.lit(None).cast("bigint").alias("set_id"), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare)
