"""Benchmark decontamination by template windows.

Numbers, units after numbers and names (capitalised words inside a sentence,
not words all in capitals) become typed placeholders; all other words
are lower-cased.  Windows of ``window`` template words of the documents are hash-joined to those of the benchmark items,
so a question asked again with other numbers or names is still found.  The values behind the placeholders are then
compared position by position: along one alignment equal values of the item must stand for equal values of the document
and different for different, else only its windows that match word for word, values included, are found.

A pair counts if at least ``least_windows`` windows of the item are found (all of them, if it has fewer).  Windows with
fewer than ``least_literal`` plain words are not used.  Items shorter than a window are one window of their own length.
Items without a usable window (too short, too many placeholders) are found as a whole, word for word with their values;
those of fewer than ``least_literal`` words only where they stand as sentences of their own.  Scripts written without
blanks are cut by character.
Null and empty texts match nothing; repeated rows count once; null ids stay null; extra columns, whatever their names, are
ignored; an empty benchmark finds nothing; a document with several alignments to an item counts with its best numbers.  All of it is column expressions and SQL joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.common import let, stored

#: Tables of up to so many narrow rows (under 64 MB) are sent to all executors, larger ones are joined by shuffle.
SMALL_ROWS = 1_000_000
#: Unit words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds ton tons ml l litre litres liter liters "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars usd euro euros eur cent cents pence percent degree degrees mph kmh watt watts kw volt volts hz khz mhz ghz kb mb gb tb"
).split()
#: Scripts without blanks between words.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[\p{{L}}&&[{_UNSPACED}]]\p{{M}}*|[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]+"
ENDS = (".", "!", "?", "\n", "。", "！", "？")
#: A number, a word, or the end of a sentence.
TOKEN = rf"\d+(?:[.,:]\d+)*|{WORD}|[{''.join(ENDS)}]"


@dataclass(frozen=True)
class Templates:
    window: int = 8
    least_literal: int = 5
    least_windows: int = 2


def parsed(text: Column) -> Column:
    """Array of (t, v): template word, and the value behind a placeholder."""

    def typed(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            first, before = F.substring(x, 1, 1), F.when(i > 0, F.get(found, i - 1))
            ends = F.coalesce(before.isin(*ENDS), F.lit(True))
            low = F.lower(x)
            digit = first.between("0", "9")
            unit = F.coalesce(F.substring(before, 1, 1).between("0", "9"), F.lit(False)) & low.isin(*UNITS)
            name = ~ends & (F.lower(first) != first) & (F.upper(x) != x)
            mark = F.when(digit, "<num>").when(unit, "<unit>").when(name, "<name>")
            return F.struct(F.coalesce(mark, low).alias("t"), F.when(mark.isNotNull(), low).alias("v"))

        return F.filter(F.transform(found, one), lambda x: ~x["t"].isin(*ENDS))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), typed)


#: A digit, or a capital letter after another word of its sentence: only such texts can have placeholders.
_OPEN = r"[0-9]|[\p{L}\p{M}][^\p{L}\p{M}0-9.!?\n]+[\p{Lu}\p{Lt}]"


def template_words(text: Column) -> Column:
    """The template words of ``parsed``; texts that cannot have placeholders are only split and lower-cased."""
    raw = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(F.lower(raw), F.lit(WORD), 0)
    return F.when(raw.rlike(_OPEN), F.transform(parsed(raw), lambda x: x["t"])).otherwise(plain)


def _windows(templates: Column, size: Column) -> Column:
    """Hash of each window of ``size`` template words; no window if there are fewer words."""
    n = F.size(templates) - size + 1
    at = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(templates, i, size)))


def row_key(key: str, text: str) -> Column:
    """A key for rows whose id may be null or come twice."""
    return F.xxhash64(F.col(key), F.col(text))


def _small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def item_windows(benchmark: DataFrame, rules: Templates, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, h, at, size, n_windows, slots): the usable windows of the items; slots: (offset, mark, value)."""
    items = benchmark.select(F.col(key).alias("item"), parsed(F.col(text)).alias("p")).distinct()
    items = items.withColumn("size", F.least(F.size("p"), F.lit(rules.window))).where(F.col("size") >= min(rules.least_literal, rules.window))
    items = items.withColumn("h", _windows(F.col("p")["t"], F.col("size")))
    opened = items.select("item", "size", "p", F.posexplode("h").alias("at", "h"))
    opened = opened.withColumn("w", F.expr("slice(p, at + 1, size)"))
    slots = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x["t"].alias("t"), x["v"].alias("v"))), lambda x: x["v"].isNotNull())
    opened = opened.withColumn("slots", slots).where(F.col("size") - F.size("slots") >= F.least(F.col("size"), F.lit(rules.least_literal)))
    return opened.select("item", "h", "at", "size", F.count("*").over(W.partitionBy("item", "p")).alias("n_windows"), "slots")


def _exact(text: Column) -> Column:
    """Array of (w, first, last): lower-case words and numbers, and whether they begin and end a sentence."""

    def marked(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            ends = lambda y: F.coalesce(y.isin(*ENDS), F.lit(True))
            before, after = F.when(i > 0, F.get(found, i - 1)), F.get(found, i + 1)
            return F.struct(F.lower(x).alias("w"), ends(before).alias("first"), ends(after).alias("last"))

        return F.filter(F.transform(found, one), lambda x: ~x["w"].isin(*ENDS))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), marked)


def _exact_windows(e: Column, size: Column, rules: Templates) -> Column:
    """Hash of each window of ``size`` words of ``_exact``; null where a short one is no sentence of its own."""

    def at(i: Column) -> Column:
        alone = F.get(e, i)["first"] & F.get(e, i + size - 1)["last"]
        return F.when((size >= rules.least_literal) | alone, F.xxhash64(F.lit("exact"), F.slice(e["w"], i + 1, size)))

    n = F.size(e) - size
    return F.transform(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), at)


def whole_items(benchmark: DataFrame, rules: Templates, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, h, at, size, n_windows, n_slots): exact windows of the items that have no usable window."""
    items = benchmark.select(F.col(key).alias("item"), F.col(text).alias("text"), parsed(F.col(text)).alias("p")).where(F.size("p") > 0).distinct()
    items = items.withColumn("size", F.least(F.size("p"), F.lit(rules.window)))
    plain = lambda i: F.size(F.filter(F.slice("p", i, F.col("size")), lambda x: x["v"].isNull()))
    some = F.exists(F.sequence(F.lit(1), F.size("p") - F.col("size") + 1), lambda i: plain(i) >= F.least("size", F.lit(rules.least_literal)))
    items = items.where((F.col("size") < min(rules.least_literal, rules.window)) | ~some)
    n_slots = F.size(F.array_distinct(F.filter("p", lambda x: x["v"].isNotNull()))).cast("bigint").alias("n_slots")
    items = items.select("item", "size", n_slots, let(_exact(F.col("text")), lambda e: _exact_windows(e, F.col("size"), rules)).alias("h"))
    return items.select("item", "size", F.size("h").cast("bigint").alias("n_windows"), "n_slots", F.posexplode("h").alias("at", "h"))


def whole_matches(docs: DataFrame, benchmark: DataFrame, rules: Templates, key: str, text: str) -> DataFrame | None:
    """The pairs of ``matches`` for items without a usable window; None if there are no such items."""
    items = stored(whole_items(benchmark, rules), "bench-wholes")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most window numbers
    if not sizes:
        return None
    hashed = lambda e: F.array(*[_exact_windows(e, F.lit(s), rules) for s in sizes])
    opened = docs.select(row_key(key, text).alias("row"), F.col(key).alias("doc_id"), F.explode(let(_exact(F.col(text)), hashed)).alias("hs"))
    opened = opened.select("row", "doc_id", F.posexplode("hs").alias("d", "h"))
    hits = opened.join(_small(items), "h").groupBy("row", "doc_id", "item", "n_windows", "n_slots", (F.col("d") - F.col("at")).alias("shift"))
    found = hits.agg(F.size(F.collect_set("at")).alias("found")).where("found = n_windows")
    return found.select("row", "doc_id", F.col("item").alias("item_id"), "n_windows", F.col("n_windows").alias("item_windows"), "n_slots").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, rules: Templates | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, item_id, n_windows, item_windows, n_slots): contaminated pairs; row is ``row_key`` of the document."""
    rules = rules or Templates()
    items = stored(item_windows(benchmark, rules), "bench-windows")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most window - 4 numbers
    known = _small(stored(items.select("h").distinct(), "bench-hashes"))
    rows = docs.select(row_key(key, text).alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def hashed(p: Column) -> Column:
        each = [_windows(p, F.lit(s)) for s in sizes] or [F.array().cast("array<bigint>")]
        return F.array(*each)

    # one list of windows for each window size; d is the position in the text
    opened = rows.select("row", "doc_id", F.explode(let(template_words(F.col("text")), hashed)).alias("hs"))
    opened = opened.select("row", "doc_id", F.posexplode("hs").alias("d", "h"))
    hits = stored(opened.join(known, "h").distinct().join(_small(items), "h").select("row", "doc_id", "item", "d", "at", "size", "n_windows", "slots"), "bench-hits")
    slotted = stored(hits.where(F.size("slots") > 0), "bench-slots")
    # values of the documents that have slots to compare
    some = _small(stored(slotted.select("row").distinct(), "bench-rows"))
    values = rows.join(some, "row", "left_semi").select("row", parsed(F.col("text")).alias("p")).dropDuplicates(["row"])
    ours = lambda s: F.get("p", F.col("d") + s["i"])["v"]
    pair = lambda s: F.struct(F.concat(s["t"], s["v"]).alias("theirs"), F.concat(s["t"], ours(s)).alias("ours"))
    line = ["row", "doc_id", "item", (F.col("d") - F.col("at")).alias("shift"), "at", "n_windows"]
    compared = slotted.join(values, "row").select(
        *line, F.forall("slots", lambda s: s["v"].eqNullSafe(ours(s))).alias("verbatim"), F.transform("slots", pair).alias("pairs")
    )
    compared = stored(compared, "bench-compared")
    pairs = compared.select("row", "item", "shift", "verbatim", F.inline("pairs"))
    pairs = pairs.groupBy("row", "item", "shift", "theirs", "ours").agg(F.max("verbatim").alias("verbatim")).groupBy("row", "item", "shift")
    slots = pairs.agg(
        F.count("*").alias("n"), F.count_distinct("theirs").alias("a"), F.count_distinct("ours").alias("b"), F.count_if("verbatim").alias("n_verbatim")
    )
    slots = slots.select(
        F.col("row").alias("row2"), F.col("item").alias("item2"), F.col("shift").alias("shift2"), "n", "n_verbatim",
        ((F.col("n") == F.col("a")) & (F.col("n") == F.col("b"))).alias("fits"),
    )
    marked = hits.where(F.size("slots") == 0).select(*line, F.lit(True).alias("verbatim")).unionByName(compared.drop("pairs"))
    lines = marked.groupBy("row", "doc_id", "item", "shift").agg(
        F.size(F.collect_set("at")).cast("bigint").alias("found"),
        F.size(F.collect_set(F.when(F.col("verbatim"), F.col("at")))).cast("bigint").alias("quoted"),
        F.max("n_windows").alias("item_windows"),
    )
    lines = lines.join(slots, F.expr("row = row2 and item <=> item2 and shift = shift2"), "left")
    fits = F.coalesce("fits", F.lit(True))
    lines = lines.withColumn("found", F.when(fits, F.col("found")).otherwise(F.col("quoted")))
    lines = lines.withColumn("n", F.coalesce(F.when(fits, F.col("n")).otherwise(F.col("n_verbatim")), F.lit(0)))
    kept = lines.where(F.col("found") >= F.least("item_windows", F.lit(rules.least_windows)))
    found = kept.groupBy("row", "doc_id", F.col("item").alias("item_id")).agg(
        F.max("found").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n").alias("n_slots")
    )
    wholes = whole_matches(docs, benchmark, rules, key, text)
    return found if wholes is None else found.unionByName(wholes)


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Templates | None = None) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots): documents that hold a passage of an item."""
    return matches(docs, benchmark, rules).groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n_slots").alias("n_slots")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, rules: Templates | None = None) -> DataFrame:
    """The documents without contaminated ones, with their own columns."""
    found = _small(stored(matches(docs, benchmark, rules).select("row").distinct(), "bench-found"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), row_key("doc_id", "text").alias("row"))
    return rows.join(found, "row", "left_anti").select("doc.*")
