"""Importance resampling, packing and the conversation trie beside brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from trailmark.llm import artree, convtrie, packing, resampling
from trailmark.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (None, "a b"), (3, " \n\t"), (3, " \n\t"), (4, "word " * 30_000), (None, None), (2**62 + 1, "Ünï <|endoftext|> 🙂 x")]


def docs(spark, rows):
    made = [(i, t, 1, 2, 3, "x") for i, t in rows]
    return spark.createDataFrame(made, "doc_id bigint, text string, rank int, length int, bucket int, chunk string")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- importance resampling ----------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_draw(rows, target):
    found = [plain_buckets(t) for _, t in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in plain_buckets(x))
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0)))) for b in range(10000)]
    made = []
    for (i, text), f in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made.append([i, len(f), weight, score, len(plain_words(text)) >= 20])
    able = sorted((m for m in made if m[4]), key=lambda m: (-m[3], m[0] is None, m[0] or 0))
    rank = defaultdict(list)
    for n, m in enumerate(able[: 5 * len(able) // 100], 1):
        rank[tuple(m[:4])].append(n)
    return Counter((*m[:4], rank[tuple(m[:4])].pop(0) if m[4] and rank[tuple(m[:4])] else None) for m in made)


def test_resampling_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()] + ODD
    target = [r.text for r in table(spark, "benchmark").collect()]
    got = resampling.resample(docs(spark, rows), table(spark, "benchmark"))
    assert Counter(map(tuple, got.collect())) == plain_draw(rows, target)
    alone = plain_draw([(r.doc_id, r.text) for r in table(spark, "documents").collect()], target)
    assert Counter(map(tuple, QUERIES["op11_importance_resampling"](spark, SF).collect())) == alone


def test_resampling_of_ties_copies_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(7, text)] * 90 + [(None, text)] * 30 + [(8, text + " x")] * 5 + [(9, "few words")]
    got = resampling.resample(docs(spark, rows), docs(spark, []))
    assert Counter(map(tuple, got.collect())) == plain_draw(rows, [])
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == [1, 2, 3, 4, 5, 6]
    assert resampling.resample(docs(spark, []), docs(spark, [])).count() == 0
    assert resampling.sampled(docs(spark, rows), got).select("doc_id").distinct().count() == 1


def test_features_of_long_words():
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choice("abé£ÿx中") for _ in range(draw.choice([1, 5, 70, 300, 5000]))) for _ in range(12)) for _ in range(20)]
    doc, bucket = resampling.features([resampling.words(t) for t in texts], resampling.WordTable())
    assert Counter(zip(doc.tolist(), bucket.tolist(), strict=True)) == Counter((i, b) for i, t in enumerate(texts) for b in plain_buckets(t))


def test_rank_is_found_among_many_ties(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 2, 2, 2, 50]) * 10, draw.choice([None, *range(30)])) for _ in range(700)]
    able = spark.createDataFrame(rows, "score bigint, doc_id bigint")
    order = sorted((-s, i is None, i or 0) for s, i in rows)
    for k in (1, 2, 350, 699, 700):
        score, nameless, one = order[k - 1]
        assert resampling.key_of_rank(able, k) == (-score, int(nameless), one)
    assert resampling.key_of_rank(able, 701) is None and resampling.key_of_rank(able, 0) is None


# --- packing ------------------------------------------------------------------


def one_by_one(counts, limit):
    """Best-two-fit of single pieces."""
    left, made = list(counts), []
    while any(left):
        own, gap = [], limit
        for length in range(limit, 0, -1):
            while left[length] and length <= gap:
                own.append(length)
                left[length] -= 1
                gap -= length
        least, best = min(own), None
        for a in range(min(limit, gap + least), 0, -1) if gap else ():
            for b in range(min(a, gap + least - a), 0, -1):
                if left[a] and left[b] and (a != b or left[a] > 1):
                    if a + b > max(least, sum(best or ())):
                        best = (a, b)
                    break
        if best:
            own.remove(least)
            left[least] += 1
            for length in best:
                left[length] -= 1
            own += best
        made.append(sorted(own))
    return sorted(made)


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_packing_one_by_one(seed):
    draw = random.Random(seed)
    limit = draw.choice([7, 20, 50, 64])
    counts = np.zeros(limit + 1, "i8")
    for _ in range(draw.randint(0, 12)):
        counts[draw.randint(1, limit)] += draw.choice([1, 2, 5, 40])
    made, got = packing.plan(counts, limit), defaultdict(list)
    for length in range(1, limit + 1):
        where = made.place(np.full(counts[length], length), np.arange(counts[length]))
        for sequence, offset in zip(*(x.tolist() for x in where), strict=True):
            got[sequence].append((offset, length))
    for own in got.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert set(got) == set(range(made.sequences))
    assert sorted(sorted(n for _, n in own) for own in got.values()) == one_by_one(counts, limit)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()] + ODD
    packed = packing.pack(docs(spark, rows), tokenizer_path(), with_ids=True)
    made = packed.collect()
    ids_of = defaultdict(list)
    for i, text in rows:
        ids_of[i].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    expected, lengths = Counter(), Counter()
    for i, lists in ids_of.items():
        for ids in lists:
            first = len(ids) % 2048 or 2048
            for piece, end in enumerate(range(first, len(ids) + 1, 2048)):
                own = ids[max(0, end - 2048) if piece else 0 : end]
                lengths[len(own)] += 1
                expected[i, piece, end - len(own), len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in made) == expected
    by = defaultdict(list)
    for r in made:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    tokens = sum(n * c for n, c in lengths.items())
    assert len(by) <= 1 + -(-tokens // 2048)
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, joined.values())) == tokens
    for r in made:
        assert joined[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_packing_nothing_copies_and_the_query(spark):
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0
    made = packing.pack(docs(spark, [(1, "one two three")] * 1500), tokenizer_path())
    assert made.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert made.select("sequence_id", "offset").distinct().count() == 1500
    assert made.select("sequence_id").distinct().count() == 3  # 512 of four tokens each
    whole = QUERIES["op12_best_two_fit"](spark, SF)
    assert whole.select("doc_id").distinct().count() == table(spark, "documents").count()
    assert dict(whole.dtypes) | {"length": "bigint"} == dict(whole.dtypes)


def test_plain_splitting_is_that_of_the_vocabulary():
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    every = [chr(c) for c in (*range(0x2C2), *range(0x2000, 0x20D0)) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c} 1{c}2 {c}" for c in every] + ["don't I'LL we've   x\n\n y  ", "", "<|endoftext|>a" + "z" * 500]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# --- conversation trie --------------------------------------------------------


def plain_trie(rows):
    convs, turns = defaultdict(list), {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    for conv in convs:
        turns[conv] = [t[3] for t in sorted(convs[conv])]
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = Counter()
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own) if made[c] == node)
        n_children = sum(1 for x in below if len(x) == len(node) + 1)
        leaves = sum(1 for x in below if x not in parents)
        up = min(members[node[:-1]]) if node else None
        out[min(own), len(node), up, len(own), n_children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


ORDER = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, **bounds):
    made = [(*r, "x", 1) for r in rows]
    turns = spark.createDataFrame(made, "conv_id bigint, turn bigint, role string, text string, ids string, depth int")
    got = convtrie.trie(convtrie.rebuilt(convtrie.sequences(turns)), **bounds)
    return Counter(tuple(r[c] for c in ORDER) for r in got.collect())


@pytest.mark.parametrize(("keys", "turns"), [(1, 1), (3, 10**6), (10**6, 17), (10**6, 10**6)])
def test_trie_equals_brute_force(spark, keys, turns):
    draw = random.Random(keys + turns)
    rows = [(None, 1, "user", "lost"), (500, None, None, None), (500, None, "", ""), (500, 3, "user", "é" * 9), (500, 3, "user", "é" * 9)]
    for c in range(70):
        same = draw.random() < 0.4
        for t in range(draw.choice([1, 2, 4, 9, 12])):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "hi" if same else draw.choice("abc")))
    rows += [(c, t, "user", "copy") for c in range(100, 140) for t in range(3)]
    rows += [(201, t, "user", "long") for t in range(40)] + [(c, 0, "user", "gone") for c in (301, 302, 303)]
    assert trie_of(spark, rows, most_keys=keys, most_turns=turns) == plain_trie(rows)


def test_trie_of_the_table_and_of_nothing(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, "conversations").collect()]
    got = QUERIES["op13_conversation_trie"](spark, SF)
    assert Counter(tuple(r[c] for c in ORDER) for r in got.collect()) == plain_trie(rows)
    assert {kind for name, kind in got.dtypes if name != "ends_sha256"} == {"bigint"}
    assert trie_of(spark, []) == Counter()
    assert trie_of(spark, [(6, 1, "user", "alone")]) == plain_trie([(6, 1, "user", "alone")])


def test_radix_tree_layouts_and_paths():
    draw, tree, kept = random.Random(2), artree.Tree(), defaultdict(list)
    keys = [bytes(draw.randrange(256) for _ in range(draw.choice([2, 4]))) for _ in range(3000)] + [b"", b"\0" * 40, b"\0" * 20]
    for n, key in enumerate(keys + keys[:50]):
        tree.insert(key, n)
        kept[key].append(n)
    found, layouts, begun = {}, Counter(), {}
    for node, depth, parent, byte in reversed(list(tree.postorder())):
        begun[id(node)] = begun[id(parent)] + bytes([byte]) + node.path if parent else b""
        assert len(begun[id(node)]) == depth
        layouts[type(node.layout).__name__, getattr(node.layout, "room", None)] += 1
        assert parent is None or node.values or sum(1 for _ in node.layout.items()) > 1  # paths are compressed
        if node.values:
            found[begun[id(node)]] = node.values
    assert found == kept
    assert set(layouts) == {("Sorted", 4), ("Sorted", 16), ("Indexed", None), ("Full", None)}
