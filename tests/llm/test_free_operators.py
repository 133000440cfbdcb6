"""Operators without SQL beside brute-force versions, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import bpe, htmltext, jaccard, langid, lmscore, warc
from trailmark.llm.components import components
from trailmark.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (None, "a b"), (3, " \n\t"), (3, " \n\t"), (4, "word " * 30_000), (None, None), (2**62 + 1, "Ünï <|endoftext|> 🙂 x")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "set", "block") for i, t in rows], "doc_id bigint, text string, set_id string, block string")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- BPE ----------------------------------------------------------------------


def reference_digest(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    draw = random.Random(3)
    letters = "ab 'sté\n\t  12!<|>  漢字🙂՘ꟁ" + "́"
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()] + ODD
    rows += [(10_000 + i, "".join(draw.choice(letters) for _ in range(draw.randrange(60)))) for i in range(300)]
    got = bpe.digests(docs(spark, rows), tokenizer_path()).collect()
    assert Counter(map(tuple, got)) == Counter((i, *reference_digest(tokenizer, t)) for i, t in rows)


def test_bpe_round_trip(spark):
    rows = [(1, "Some text, with don't and 12 <|endoftext|>."), (2, None), (3, "é🙂")]
    encoded = bpe.encode(docs(spark, rows), tokenizer_path())
    assert {r.doc_id: r.text for r in bpe.decode(encoded, tokenizer_path()).collect()} == {1: rows[0][1], 2: "", 3: "é🙂"}
    assert bpe.digests(docs(spark, []), tokenizer_path()).count() == 0


# --- Jaccard join -------------------------------------------------------------


def brute(rows, percent=75):
    sets, size = defaultdict(list), {}
    for i, t in rows:
        w = tuple((t or "").encode().lower().split())
        s = frozenset(w[k : k + 5] for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([w] if w else [])
        sets[s].append(i)
        size[i] = len(s)
    full = [s for s in sets if s]
    parent = list(range(len(full)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(full)):
        for b in range(a):
            o = len(full[a] & full[b])
            if 100 * o >= percent * (len(full[a]) + len(full[b]) - o):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for k, s in enumerate(full):
        least[find(k)] = min([least[find(k)], *sets[s]])
    named = {i: least[find(k)] for k, s in enumerate(full) for i in sets[s]}
    return {(i, size[i], named.get(i, i)) for i, _ in rows}


def test_join_equals_brute_force_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert {tuple(r) for r in QUERIES["op8_jaccard_join"](spark, SF).collect()} == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_join_of_groups_around_a_base(spark, seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(300)}"
    rows = []
    for _ in range(4):
        base = [word() for _ in range(draw.choice([8, 30, 80]))]
        for _ in range(40):
            copy = list(base)
            for _ in range(draw.randrange(6)):
                at = draw.randrange(len(copy))
                copy[at : at + 1] = draw.choice([[], [word()], [copy[at], word()]])
                copy = copy or [word()]
            rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(draw.randrange(9))) for _ in range(60)]
    rows = list(enumerate(rows))
    got = jaccard.join(docs(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_join_odd_rows(spark):
    rows = ODD + [(7, "A b"), (8, "x")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows)).collect())
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (None, 1, 7): 1, (3, 0, 3): 2, (4, 1, 4): 1, (None, 0, None): 1, (2**62 + 1, 1, 2**62 + 1): 1, (7, 1, 7): 1, (8, 1, 8): 1})
    assert jaccard.join(docs(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (7, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


# --- LM scoring ---------------------------------------------------------------


def test_base_score_counts_and_model(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = {r.doc_id: r for r in QUERIES["op1_lm_score"](spark, SF).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_model_is_a_distribution():
    draw = np.random.default_rng(1)
    model = lmscore.Model.from_counts(draw.integers(0, 50, lmscore.SLOTS))
    model.class_weights += draw.normal(0, 1, model.class_weights.shape).astype("f4")
    model.member_weights += draw.normal(0, 1, model.member_weights.shape).astype("f4")
    rows = lmscore.features(np.array([5, 6, 7], "u8"), np.array([0]), np.array([3]))[2:]
    total = np.exp(lmscore.log_slots(model, np.arange(lmscore.SLOTS), np.repeat(rows, lmscore.SLOTS, 0))).sum()
    assert total == pytest.approx(1, abs=1e-5)


def test_gradients_agree_at_the_start():
    draw = np.random.default_rng(2)
    slots = draw.integers(0, lmscore.SLOTS, 500)
    model = lmscore.Model.from_counts(np.bincount(slots, minlength=lmscore.SLOTS))
    rows = lmscore.features(slots.astype("u8"), np.array([0]), np.array([500]))
    assert np.allclose(lmscore.gradient(model, slots, rows), lmscore.bias_gradient(model, slots, rows), atol=1e-3)


def test_every_training_document_is_in_one_gradient_of_the_model(monkeypatch):
    block = SimpleNamespace(ids=[*range(1, 2000), None], flags=np.arange(2000) % 7 != 2)
    chosen = []
    monkeypatch.setattr(lmscore, "_summed", lambda made, each, keep: [chosen.append(keep(block)), np.zeros(4 * lmscore.ROWS * lmscore.CLASSES)][1])
    lmscore.train(None, np.ones(lmscore.SLOTS, "i8"))
    assert (chosen[0] == block.flags).all()
    assert (np.sum(chosen[1:], axis=0) == block.flags).all()


def test_gradient_is_the_sum_over_tokens(monkeypatch):
    monkeypatch.setattr(lmscore, "BATCH", 64)
    draw = np.random.default_rng(3)
    slots, width = draw.integers(0, lmscore.SLOTS, 150), lmscore.CLASSES
    model = lmscore.Model.from_counts(np.bincount(slots, minlength=lmscore.SLOTS))
    model.class_weights += draw.normal(0, 1, model.class_weights.shape).astype("f4")
    model.member_weights += draw.normal(0, 1, model.member_weights.shape).astype("f4")
    rows = lmscore.features(draw.integers(0, 9, 150).astype("u8"), np.array([0, 100]), np.array([100, 50]))
    want = np.zeros((4, lmscore.ROWS, width))
    for slot, row in zip(slots, rows, strict=True):
        c, m = divmod(slot, lmscore.MEMBERS)
        member_row = lmscore._member_rows(row[None], np.array([c]))[0]
        for into, own, bias, weights, seen in ((0, row, model.class_bias, model.class_weights, c), (2, member_row, model.member_bias[c], model.member_weights, m)):
            chances = np.exp((bias + weights[own].sum(0)).astype("f8"))
            chances /= chances.sum()
            for r in own:
                want[into, r] += np.eye(width)[seen] - chances
                want[into + 1, r] += chances
    assert np.allclose(lmscore.gradient(model, slots, rows), want.ravel(), atol=1e-4)


def test_scores_equal_those_of_a_model_trained_in_one_place(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("abcdefghij") + draw.choice("xyz") for _ in range(draw.randrange(1, 60)))) for i in range(400)]
    got = {r.doc_id: r.score for r in lmscore.scores(docs(spark, rows).repartition(3)).collect()}
    texts = {i: t.encode().split() + [b"\n"] for i, t in rows}
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in learned for w in texts[i])
    slot_of = lambda ws: (lmscore.word_hashes(ws) % np.uint64(lmscore.SLOTS)).astype("i8")
    n, v = (np.bincount(slot_of(list(count)), by, lmscore.SLOTS) for by in (list(count.values()), [1] * len(count)))

    def seen(ids):
        sizes = np.array([len(texts[i]) for i in ids])
        hashes = lmscore.word_hashes([w for i in ids for w in texts[i]])
        return (hashes % np.uint64(lmscore.SLOTS)).astype("i8"), lmscore.features(hashes, np.cumsum(sizes) - sizes, sizes)

    model = lmscore.Model.from_counts(n)
    model = model.stepped(lmscore.bias_gradient(model, *seen(learned)), 0.25, 400.0)
    for share in range(8):
        own = [i for i in learned if (i * 0x9E3779B97F4A7C15 % 2**64 >> 33) % 8 == share]
        model = model.stepped(lmscore.gradient(model, *seen(own)), 0.25, 400.0 / 8)
    for i, ws in texts.items():
        slots = slot_of(ws)
        inside = np.log10([count[w] + 1 for w in ws]) - np.log10(n[slots] + v[slots] + 1)
        assert got[i] == pytest.approx((lmscore.log_slots(model, *seen([i])) / np.log(10) + inside).sum(), rel=1e-5)


def test_scores_of_odd_rows(spark):
    got = lmscore.scores(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert lmscore.scores(docs(spark, [])).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = lmscore.scores(docs(spark, [(alone, "x y")])).first()
    assert (one.train_tokens, one.n_known, one.base_score) == (0, 0, 0.0)


# --- WARC ---------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives_round_trip(spark):
    big = "é" * 400_000
    rows = [(1, "a", "x"), (2, "b", "x"), (3, None, None), (4, "c\nd", ""), (None, "e", "x"), (2, "b", "x"), (2**62 + 1, "z", big), (9, "y", "\r\n\r\nWARC/1.0\r\n\r\n")]
    got = warc.round_trip(pages(spark, rows)).collect()
    expected = Counter()
    for i, _, h in rows:
        payload = (h or "").encode()
        last = max(j for j, _, g in rows if (g or "") == (h or "") and j is not None)
        to = last if i is not None and i < last else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected[i, len(payload), digest, "response" if to is None else "revisit", to] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_members_open_alone_and_make_the_same_stream(spark, tmp_path):
    folder = f"file://{tmp_path}"
    streams = warc.write(table(spark, "pages"), f"{folder}/a")
    members = warc.normalise(streams, f"{folder}/b")
    whole = Counter(x for r in streams.collect() for x in warc.records_of(warc.inflated(r.archive)))
    single = Counter()
    for r in warc.read(members).collect():
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.at)
            single[zlib.decompress(f.read(r.length), 31)] += 1
    assert whole == single and sum(whole.values()) == table(spark, "pages").count()


# --- HTML ---------------------------------------------------------------------


def test_blocks_of_broken_pages():
    texts = lambda page: [x.text for x in htmltext.leaves(page)]
    assert texts("<p>a &amp;\n b<br>c<p><b>d</b>e &am") == ["a & b c", "de &am"]
    assert texts('<script>var t="</p>x";</script><p title="a > b">y</p><!-- z --><p') == ["y"]
    assert texts("1 < 2 and <b>3</b> > 2") == ["1 < 2 and 3 > 2"]
    assert texts("") == [] and texts("<style>p{}") == []


def test_raw_elements_end_where_they_end():
    texts = lambda page: [x.text for x in htmltext.leaves(page)]
    assert texts("<html><head><meta charset=x><title>t</title><body><p>kept</p>") == ["kept"]
    assert texts("<head><script>'<p>'</script><p>kept</p>") == ["kept"]
    assert texts("<p>one</p><svg class=x /><p>two</p><svg><text>no</text></svg><p>three") == ["one", "two", "three"]
    assert texts("<head-line>one</head-line><title-bar>two</title-bar><object-view>three</object-view>") == ["one", "two", "three"]
    assert texts("<p>with <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> in it</p>") == ["with x=2 in it"]
    assert texts("<p>one</p><select><p>two</p><iframe src=x><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><script>var x<p>no</p>") == ["one"]


def test_extraction_of_pages_not_learned_from(spark):
    rows = {r.page_id: r.html for r in table(spark, "pages").collect()}
    got = {r.page_id: r for r in QUERIES["op2_html_blocks"](spark, SF).collect()}
    right = 0
    for i, page in rows.items():
        found = htmltext.leaves(page)
        right += got[i].text == "\n".join(x.text for x in found if htmltext.rule(x))
        assert got[i].n_chars == len(got[i].text)
    assert right >= 0.97 * len(rows)


def test_labeller_uses_other_names(spark):
    page = (
        "<html><body><header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies.</p></div><main><h1>Title</h1><p>First part of the text,"
        " with many words in it, as it goes.</p><aside class='sidebar'><p>Other things</p></aside><p>Second part &amp; more words, said once again.</p></main>"
        "<section class='comments'><div class='comment'><p>Thanks a lot!</p></div></section><form><label>Mail</label></form><footer>me</footer></body></html>"
    )
    labeller = htmltext.trained(table(spark, "pages"))
    found = htmltext.leaves(page)
    kept = [x.text for x, y in zip(found, labeller.labels([htmltext.vectors(found)])[0], strict=True) if y]
    assert kept == ["Title", "First part of the text, with many words in it, as it goes.", "Second part & more words, said once again."]


def test_gradients_of_the_labeller():
    draw = np.random.default_rng(4)
    model = htmltext.Labeller()
    x, mask = draw.normal(0, 1, (5, 3, htmltext.WIDTH)).astype("f4"), np.ones((5, 3), "f4")
    mask[3:, 1] = 0
    y = (draw.random((5, 3)) < 0.5).astype("f4")

    def loss():
        z = model.logits(x, mask).astype("f8")
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    g = model.gradients(x, mask, y)
    for name in ("xf", "hb", "bf", "o"):
        flat, at = model.w[name].reshape(-1), int(np.abs(g[name]).argmax())
        kept = flat[at]
        flat[at] = kept + 1e-2
        up = loss()
        flat[at] = kept - 1e-2
        down = loss()
        flat[at] = kept
        assert (up - down) / 2e-2 == pytest.approx(float(g[name].reshape(-1)[at]), rel=0.05, abs=1e-4)


def test_extraction_of_odd_pages(spark):
    got = htmltext.extract(pages(spark, [(1, "u", None), (1, None, ""), (None, "v", "<p>x"), (2, "w", "<article>" + "<p>some words</p>" * 5000)])).collect()
    assert len(got) == 4 and {r.text for r in got if r.page_id == 1} == {""}
    assert htmltext.extract(pages(spark, [])).count() == 0


# --- Language -----------------------------------------------------------------


def test_accuracy_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in table(spark, "documents").collect()}
    got = QUERIES["op4_language_id"](spark, SF).collect()
    held = [r for r in got if r.held_out and rows[r.doc_id].lang and r.lang_pred != "und"]
    assert len(got) == len(rows) and len(held) > 20
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, f"the cat and the dog number {i}", "en") for i in range(30)] + [(100 + i, f"der hund und die katze nummer {i}", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "12 34 !", "de"), (None, "und die katze", None), (202, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[None][0] == "de" and got[5][0] == "en"
    assert langid.identify(df.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
