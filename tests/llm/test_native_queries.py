"""Queries with SQL beside DuckDB, and the cases every operator has to stand."""

from __future__ import annotations

import random
import textwrap
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import _counted, connect
from trailmark.llm import decontam, licences, linededup, quality
from trailmark.llm.licence_texts import KNOWN
from trailmark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_md5 string"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _counted(df.columns, df.collect()) == _counted(columns, result.fetchall())


@pytest.mark.parametrize("name", "op3_quality_rules op5_template_decontamination op7_licence_digests".split())
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "MapIn", "FlatMapGroups") if x in plan]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x") for i, t, lang in rows], DOCS)


ODD = [(1, None, None), (2, "", "en"), (None, "a b", "en"), (3, " \n\t", "de"), (3, " \n\t", "de"), (4, "word " * 30_000, "en")]


# --- Quality rules ------------------------------------------------------------


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_quality_odd_rows(spark):
    got = quality.verdicts(docs(spark, ODD), labels(spark, [(4, 1, 0), (99, None, 1)])).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[2].n_words, by[None].n_words, by[4].n_words) == (0, 0, 2, 30_000)
    assert by[4].n_repeat_words == 30_000 and by[4].base_failed and not by[1].kept
    empty = docs(spark, []), labels(spark, [])
    assert quality.verdicts(*empty).count() == 0
    assert quality.filtered(*empty).columns == docs(spark, []).columns


def test_quality_cutoff_is_safe_and_useful(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(20)), "en") for i in range(1200)]
    bad = [(5000 + i, " ".join(f"b{i}x{k}###" for k in range(20)), "en") for i in range(50)]
    other = [(9000 + i, " ".join(f"c{i}x{k}###" for k in range(20)), "de") for i in range(50)]
    truth = [(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad + other] + [(1, None, 0), (None, 1, 0), (77_777, 1, 0)]
    got = quality.verdicts(docs(spark, good + bad + other), labels(spark, truth)).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= {i for i, _, _ in good}
    assert not kept & {i for i, _, _ in bad}
    assert kept >= {i for i, _, _ in other}  # a stratum without good documents has no safe cutoff
    stay = quality.filtered(docs(spark, good + bad + other), labels(spark, truth))
    assert {r.doc_id for r in stay.collect()} == kept and stay.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")


def test_rules_hold_jointly_and_equal_sql(spark, tmp_path):
    draw = random.Random(8)

    def text(i, marks, symbols):
        return " ".join(f"w{i}x{k}" + "!" * (draw.random() < marks) + "#" * (draw.random() < symbols) for k in range(25))

    rows, truth = [], []
    for lang, n in (("en", 900), ("fr", 300), ("xx", 60), (None, 0)):
        for _ in range(n):
            i = len(rows)
            bad = draw.random() < 0.3
            # many exclamation marks are bad, but in French good texts have them too
            marks = draw.choice([0, 0.6]) if bad or (lang == "fr" and draw.random() < 0.2) else 0
            rows.append((i, text(i, marks, draw.choice([0, 0.9]) if bad else draw.random() < 0.004), lang))
            truth += [(i, int(not bad), 0)] * draw.choice([0, 1, 1, 1, 2])
    df, marked = docs(spark, rows + ODD), labels(spark, truth)
    measured = quality._measured(df, quality.Rules())
    found = {(r.stratum, r.rule): r for r in quality.tested(measured, marked, quality.Rules()).where("safe").collect()}
    assert ("en", "marks") in found and ("en", "symbols") in found and ("fr", "symbols") in found
    assert ("fr", "marks") not in found and not any(s == "xx" for s, _ in found)  # too many good ones, too few labels
    assert all(r.k_good <= 0.05 * r.n_good for r in found.values())
    got = quality.verdicts(df, marked)
    equals_sql(spark, tmp_path, "op3_quality_rules", got, documents=df, labels=marked)
    kept = {r.doc_id for r in got.where("kept").collect()}
    good = {i for i, q, _ in truth if q == 1}
    assert len(good - kept) <= 0.05 * len(good) and 0 < len(kept - good) < len(rows) - len(good)
    many = quality.filtered(df, marked, quality.Rules(sent_ids=10))
    assert sorted(r.doc_id for r in many.collect()) == sorted(r.doc_id for r in quality.filtered(df, marked).collect()) == sorted(kept)


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((50, 0, 0.05), (200, 3, 0.01), (1000, 20, 0.03), (100_000, 700, 0.008)):
        got = spark.range(1).select(quality.tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p)).first()[0]
        exact = 0.0
        term = None
        from math import exp, lgamma, log

        exact = sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1))
        if n < 300:
            term = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert got == pytest.approx(term, rel=1e-9)
        assert got == pytest.approx(exact, rel=1e-6)


# --- Decontamination ----------------------------------------------------------

QUESTION = "Tom has 3 apples and buys 5 more apples from the market for 3 dollars today in London city"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_templates_match_other_values(spark):
    texts = [
        (1, QUESTION, "en"),
        (2, "so: Ann has 7 apples and buys 9 more apples from the market for 7 euros today in Paris city", "en"),
        (3, "Ann has 7 apples and buys 9 more apples from the market for 8 euros today in Paris city", "en"),
        (4, "nothing of the kind stands here at all, only other words that make a text", "en"),
    ]
    got = decontam.contaminated(docs(spark, texts + ODD), items(spark, [(10, QUESTION), (11, None), (12, "short")])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 10), (2, 10)}
    left = decontam.decontaminated(docs(spark, texts + ODD), items(spark, [(10, QUESTION)]))
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted([3, 4] + [i or -1 for i, *_ in ODD if i not in (3, 4)] + [3, 3, 4])
    assert left.columns == docs(spark, []).columns


def test_quotes_stay_found_beside_a_changed_value(spark):
    start = "in the year 1998 all the people of the small village went down to the old river and"
    end = "looked for the lost boat of their king until the end of 1998 when it came back"
    texts = [
        (1, f"{start} {end}", "en"),
        (2, f"{start} {end.replace('1998', '1999')}", "en"),  # equal values became different
        (3, f"{start.replace('1998', '1888')} other words stand here for the rest {end.replace('1998', '1777')}", "en"),
        (4, "in the year 1998 all the people of another town", "en"),  # one window, no more
    ]
    got = decontam.contaminated(docs(spark, texts), items(spark, [(10, f"{start} {end}")])).collect()
    by = {r.doc_id: (r.n_windows, r.n_slots) for r in got}
    assert set(by) == {1, 2, 3}
    assert by[1] == (28, 1) and by[2] == (23, 1)  # five windows hold the changed value
    two = "the man counted 4 green birds in the tall tree beside the road and then 9 more birds far away from all of the other trees of the field"
    same = two.replace("4", "6").replace("9", "6")  # different values became equal
    assert decontam.contaminated(docs(spark, [(1, same, "en")]), items(spark, [(10, two)])).count() == 1


def test_items_without_a_usable_window_are_found_whole(spark):
    dense = "Add 3 and 5 and 7 then 9 and 11 to 13"  # more than three placeholders in every window
    chinese = "小明有三个苹果他又买了五个苹果现在一共有多少"
    texts = [
        (1, f"Some text.\n{dense}\nmore text", "en"),
        (2, f"Some text.\n{dense.replace('11', '12')}\nmore text", "en"),
        (3, "First this. What is 2+2? Then that", "en"),
        (4, "I know what is 2+2 because of school", "en"),
        (5, "What is 2+3?", "en"),
        (6, f"前面还有别的话说{chinese}后面也有", "zh"),
        (7, "小红有两个梨她没有再买别的东西所以很高兴", "zh"),
    ]
    known = items(spark, [(10, dense), (11, "What is 2+2?"), (12, chinese), (13, None), (14, "")])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, texts + ODD), known).collect()}
    assert got == {(1, 10), (3, 11), (6, 12)}


def test_decontamination_equals_sql(spark, tmp_path):
    draw = random.Random(12)
    plain = "the man found green birds in tall tree beside old road and then went home to his wife because of rain".split()
    marks = ["3", "7", "12 km", "5 kg", "Ann", "Bob", "Paris", "2.5", "9 days"]

    def text(n, marked):
        return " ".join(draw.choice(marks) if draw.random() < marked else draw.choice(plain) for _ in range(n))

    known = [text(draw.choice([2, 4, 6, 9, 14, 30]), draw.choice([0, 0.1, 0.3, 0.6])) for _ in range(40)]
    known += ["What is 2+2?", "小明有三个苹果他又买了五个苹果现在一共有多少", QUESTION, "", "Yes. No!", "กินข้าวกับแม่ที่บ้านในวันนี้"]

    def asked():
        found = draw.choice(known)
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            a, b = draw.choice(marks), draw.choice(marks)
            found = found.replace(a, b) if draw.random() < 0.5 else found.replace(a, b, 1)
        words = found.split(" ")
        if draw.random() < 0.3 and len(words) > 3:
            words[draw.randrange(len(words))] = "other"
        return " ".join(words)

    rows = [(i, draw.choice(["", "Text before. ", "and so "]) + asked() + draw.choice(["", ". More", "\nAfter it", " 然后"]), "en") for i in range(250)]
    df = docs(spark, rows + ODD[:5])
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(known)] + [(99, None), (0, known[0])], "item_id bigint, text string")
    got = decontam.contaminated(df, bench)
    assert got.where("n_slots > 0").count() > 20 and got.where("n_windows < item_windows").count() > 5
    equals_sql(spark, tmp_path, "op5_template_decontamination", got, documents=df, benchmark=bench)


def test_decontamination_of_empty_tables(spark):
    assert decontam.contaminated(docs(spark, []), items(spark, [(1, QUESTION)])).count() == 0
    assert decontam.contaminated(docs(spark, [(1, QUESTION, "en")]), items(spark, [])).count() == 0
    assert decontam.contaminated(docs(spark, [(None, QUESTION, "en"), (None, QUESTION, "en")]), items(spark, [(1, QUESTION)])).count() == 1


def test_plain_path_equals_parsing(spark):
    texts = ["Ein Satz. Noch einer", "Mit Namen Anna darin", "3 km weit", "ALL CAPS here", "", "ΣΑΣ λόγος", "a É b", "x\nY z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.transform(decontam.parsed(F.col("t")), lambda x: x["t"])
    assert df.where(slow != decontam.template_words(F.col("t"))).count() == 0


# --- Licences -----------------------------------------------------------------


def test_whole_licence_in_other_dress(spark):
    text = dict(KNOWN[:1])["MIT"]
    dressed = "The MIT Licence (MIT)\n\nCopyright © 2020 Some Body\nAll rights reserved.\n\n" + text.replace(" ", "  ").upper().replace("SUBLICENSE", "SUB-LICENSE")
    rows = [(1, dressed, "en"), (2, "a\nReleased under the MIT licence\nReleased under the MIT License!\nb", "en"), (5, text[:-20], "en")]
    got = {(r.doc_id, r.licence, r.scope): r.n for r in licences.scan(docs(spark, rows + ODD)).collect()}
    assert got == {(1, "MIT", "text"): 1, (2, "MIT", "line"): 2}
    assert licences.scan(docs(spark, [])).count() == 0
    known = spark.createDataFrame([("own", "My own terms."), ("none", None)], "licence string, text string")
    assert [(r.doc_id, r.licence) for r in licences.scan(docs(spark, [(1, "my OWN terms", "en")]), known).where("scope = 'text'").collect()] == [(1, "own")]


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width))


def test_licences_inside_of_other_text(spark, tmp_path):
    text = dict(KNOWN[:1])["MIT"]
    zlib_text = dict(KNOWN)["Zlib"]
    rows = [
        (1, f"# My program\nSome words.\n\nCopyright (c) 2020 X. Y.\n{wrapped(text, 60)}\n\nMore words of mine.", "en"),
        (2, f"{wrapped(text, 33)}\n{wrapped(zlib_text, 50)}", "en"),
        (3, "(c) 2020 Some Body. Released under the MIT License.\nCopyright 2021 J. Smith, Inc.", "en"),
        (4, wrapped(text, 60).replace("furnished", "burnished") + "\nmore", "en"),
        (5, "Permission is hereby granted\nto nobody", "en"),
        (6, wrapped(text, 70), "en"),
    ]
    df = docs(spark, rows + ODD)
    got = {(r.doc_id, r.licence, r.scope): r.n for r in licences.scan(df).collect()}
    assert got == {(1, "MIT", "run"): 1, (2, "MIT", "run"): 1, (2, "Zlib", "run"): 1, (3, "MIT", "line"): 1, (3, "MIT", "text"): 1, (6, "MIT", "text"): 1}
    equals_sql(spark, tmp_path, "op7_licence_digests", licences.scan(df), documents=df)
    both = spark.createDataFrame([("one", "The very same terms hold here"), ("two", "the very same TERMS hold here.")], "licence string, text string")
    twice = licences.scan(docs(spark, [(1, "The very same terms hold here", "en")] * 2), both).collect()
    assert {(r.licence, r.scope, r.n) for r in twice} == {(x, s, 2) for x in ("one", "two") for s in ("text", "line")}
    assert licences.scan(df, both.where("false")).count() == 0


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_long_licences_by_digest(spark):
    published = {"GPL-3.0-only": "GPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1-only": "LGPL-2.1"}
    texts = {i: Path("/usr/share/common-licenses", f).read_text() for i, f in published.items()}
    rows = [(n, f"{t}\nand some code" if n % 2 else " ".join(t.split("\n")[:1]) + t[len(t.split("\n")[0]) :], "en") for n, t in enumerate(texts.values())]
    got = {(r.doc_id, r.licence, r.scope) for r in licences.scan(docs(spark, rows)).where("licence in ('GPL-3.0-only', 'Apache-2.0', 'MPL-2.0', 'LGPL-2.1-only') and scope <> 'line'").collect()}
    assert {(n, i, "run" if n % 2 else "text") for n, i in enumerate(texts)} <= got


# --- Lines --------------------------------------------------------------------


def test_recurring_templates_stay_in_the_first_document(spark):
    shared = "this line stands in more than one text"
    rows = [
        (1, f"{shared}\nown words of the first text here", "en"),
        (2, f"own words of the second text here\n{shared}", "en"),
        (3, shared, "en"),
        (4, "user 17 logged in from 10.0.0.1 at noon", "en"),
        (5, "user 18 logged in from 10.0.0.2 at noon\nand then left the house again", "en"),
        (6, "a b c", "en"),
        (7, "a b c", "en"),
        (8, "one two three four five six seven eight nine ten eleven twelve", "en"),
        (9, "one two three four NEW WORDS seven eight nine ten eleven twelve\nand a line of its own here", "en"),
    ]
    got = {r.doc_id: r.text for r in linededup.cleaned(docs(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "own words of the second text here" and 3 not in got
    assert got[4] == rows[3][1] and got[5] == "and then left the house again"
    assert got[6] == got[7] == "a b c"
    assert got[9] == "and a line of its own here"
    counted = {r.doc_id: r.n_dropped for r in linededup.report(docs(spark, rows)).collect()}
    assert counted == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0, 9: 1}


def equals_sql(spark, tmp_path, name, got, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / table))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}/*.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert _counted(got.columns, got.collect()) == _counted(columns, result.fetchall())


def test_short_lines_go_where_they_are_common(spark):
    rows = [(i, f"All rights reserved.\nown words of text number {'abcdefghijklmnopqrstuvwxyz'[i]} stand here", "en") for i in range(12)]
    rows += [(100 + i, f"Yes, sure.\nother words {i} of another person", "en") for i in range(9)]
    got = {r.doc_id: r.text for r in linededup.cleaned(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all("rights" not in got[i] for i in range(1, 12))
    assert all(got[i] == t for i, t, _ in rows if i >= 100 and "0" in t.split()[4])
    assert all("Yes, sure." in got[100 + i] for i in range(9))  # nine documents are no common line


def test_a_line_loses_few_words_of_its_own(spark):
    shared = [f"shared{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(24)]
    one, two = " ".join(shared[:12]), " ".join([*shared[:5], "own", *shared[6:12]])
    long = " ".join([*shared[:8], *[f"new{'abcdefghij'[k]}" for k in range(6)], *shared[14:]])
    rows = [(1, one, "en"), (2, two + "\nsecond line of this very text", "en"), (3, " ".join(shared), "en"), (4, long, "en"), (5, " ".join(shared), "en")]
    got = {r.doc_id: r.text for r in linededup.cleaned(docs(spark, rows)).collect()}
    assert got == {1: one, 2: "second line of this very text", 3: rows[2][1], 4: long}


def test_lines_equal_sql(spark, tmp_path):
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "12", "a@b.c", "delta", "7x", "http://q.r"]
    frames = [[draw.choice(words) for _ in range(draw.choice([1, 2, 3, 5, 6, 9, 10, 12, 17, 18, 19, 22, 23, 30]))] for _ in range(60)]

    def line():
        own = list(draw.choice(frames))
        for _ in range(draw.choice([0, 0, 1, 3])):
            own[draw.randrange(len(own))] = draw.choice([*words, "other", "99"])
        return draw.choice(["", " "]) + " ".join(own)

    rows = [(draw.choice([None, *range(90)]), "\n".join(line() for _ in range(draw.randrange(7))), "en") for _ in range(150)] + ODD
    df = docs(spark, rows).dropDuplicates(["doc_id", "text"])
    equals_sql(spark, tmp_path, "op10_line_templates", linededup.report(df), documents=df)


def test_lines_odd_rows(spark):
    got = linededup.cleaned(docs(spark, ODD + [(None, "five words stand in here", "x"), (7, "five words stand in here", "x")]))
    assert got.columns == docs(spark, []).columns
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in got.collect()) == [(-1, 3), (1, 0), (2, 0), (3, 3), (3, 3), (4, 150_000), (7, 24)]
    assert linededup.cleaned(docs(spark, [])).count() == 0


def test_lines_of_values_recur_only_as_they_are(spark):
    rows = [
        (1, "12 7 31 5 90", "en"),
        (2, "13 8 32 6 91", "en"),
        (3, "2020-01-05 a@b.org http://x.org/1 17 total\n12 7 31 5 90\n5 6 7 8 9", "en"),
        (4, "2021-02-06 c@d.org http://x.org/2 18 total", "en"),
        (5, "row 1 2 3 4 5 6 7 8 9 10 has many numbers", "en"),
        (6, "row 1 2 3 4 5 6 7 8 9 11 has many numbers", "en"),
        (7, "on 1 may the 2 of us met 3 men twice", "en"),
        (8, "on 4 may the 5 of us met 6 men twice\nand then left the house again", "en"),
    ]
    got = {r.doc_id: r.text for r in linededup.cleaned(docs(spark, rows)).collect()}
    assert {i: got.get(i) for i in (1, 2, 4, 5, 6, 7)} == {i: t for i, t, _ in rows if i in (1, 2, 4, 5, 6, 7)}
    assert got[3] == "2020-01-05 a@b.org http://x.org/1 17 total\n5 6 7 8 9"  # the very same row stands in document 1
    assert got[8] == "and then left the house again"
