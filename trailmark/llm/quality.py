"""Quality rules with risk-controlled cutoffs.

Base measures decide alone on very short and very repetitive texts.  Every other rule compares one measure with a
cutoff.  For each stratum (language) cutoffs are chosen on the labelled documents of that stratum in two steps:

* A third of them, by a hash of the id, proposes: cutoffs that reject more bad documents than good ones, weighted by
  ``good_weight``, are put in a row, those with the fewest rejected good documents first.
* The other two thirds, the holdout, decide: cutoffs are taken over from the row one after the other as long as the exact
  binomial bound shows that all taken so far together falsely reject at most ``risk`` of the stratum.  The first one for
  which it does not ends the row.

What is tested is the joint rejection of all rules, in an order the holdout had no part in, so each stratum spends its
share of ``delta`` once for its whole row, and the promise holds in all strata together with probability 1 - ``delta``.
The shares are equal (Bonferroni): a stratum needs ln(strata / delta) / -ln(1 - risk) good documents in its holdout, 86
for four strata, before any cutoff can apply; with fewer it keeps to the base rule.

Null and blank texts have no words and fail the base rule.  A null language is a stratum of its own.  Labels without a
document, with a null label or of a document without a label count nowhere; a label row that comes twice counts twice.
Cutoffs with the same numbers come in the order of gain, rule and cutoff, high cutoffs first.
Repeated documents each get a row.  Without labels only the base rules hold.  Extra columns are ignored.
All of it is column expressions and SQL aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.common import BLANKS, let, stored, words

MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_marks".split()


@dataclass(frozen=True)
class Rules:
    """Limits of the base rule, candidate cutoffs by rule, and the promised risk."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    cutoffs: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbols": (0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
            "marks": (0.05, 0.1, 0.25, 0.5),
            "capitals": (0.1, 0.2, 0.35, 0.5),
            "dup_lines": (0.1, 0.2, 0.3, 0.5),
            "repeats": (0.05, 0.1, 0.15),
            "word_length": (8.0, 10.0, 14.0),
        }
    )
    risk: float = 0.05
    delta: float = 0.05
    good_weight: float = 20.0

    #: Ids of labelled documents up to this number (16 MB) are sent to all tasks, so that only their texts are measured.
    sent_ids: int = 2_000_000


def _repeat_words(found: Column, window: int) -> Column:
    """Words that lie in a window found at least twice."""
    n = F.size(found) - (window - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(found, i, window)))
    return F.when(n < 2, F.lit(0)).otherwise(let(hashes, lambda h: _covered(h, window)))


def _covered(hashes: Column, window: int) -> Column:
    def same(a: Column, k: Column, step: int) -> Column:
        return F.coalesce(F.get(a, k + step)["h"] == F.get(a, k)["h"], F.lit(False))

    def starts(a: Column) -> Column:
        return F.filter(F.transform(a, lambda x, k: F.when(same(a, k, -1) | same(a, k, 1), x["i"])), lambda i: i.isNotNull())

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spans = F.transform(let(placed, starts), lambda i: F.sequence(i, i + (window - 1)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(spans))))


def measures(text: Column, rules: Rules) -> Column:
    """All measures of a text as one struct."""

    def made(raw: Column, found: Column, lines: Column) -> Column:
        drop = lambda pattern: F.length(F.regexp_replace(raw, pattern, ""))
        values = {
            "n_words": F.size(found),
            "word_chars": drop(BLANKS),
            "n_symbols": drop(r"[^#*$%&|<>]+"),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(found, rules.window),
            "n_lines": F.size(lines),
            "n_capitals": drop("[^A-Z]+"),
            "n_marks": drop("[^!]+"),
        }
        return F.struct(*[values[m].cast("bigint").alias(m) for m in MEASURES])

    def lines(raw: Column) -> Column:
        return F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    raw = F.coalesce(text, F.lit(""))
    return let(words(raw), lambda w: let(lines(raw), lambda x: made(raw, w, x)))


def base_failed(m: Column, rules: Rules) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def _values(m: Column, rules: Rules) -> dict[str, Column]:
    each = lambda a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0))
    known = {
        "symbols": each("n_symbols", "n_words"),
        "marks": each("n_marks", "n_words"),
        "capitals": each("n_capitals", "word_chars"),
        "dup_lines": each("n_dup_lines", "n_lines"),
        "repeats": each("n_repeat_words", "n_words"),
        "word_length": each("word_chars", "n_words"),
    }
    return {name: known[name] for name in rules.cutoffs}


def _stratum(lang: str) -> Column:
    return F.coalesce(F.col(lang), F.lit(""))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(a binomial count of n trials with chance p is at most k), summed in logarithms."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), (n * F.log(F.lit(1 - p))).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        high = F.greatest(a["s"], t)
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(F.least(a["s"], t) - high))).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, step)["s"])


def proposing(key: str) -> Column:
    """Whether a labelled document proposes cutoffs: about a third do."""
    return F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1).isin(*"01234")


def held_documents(measured: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, stratum, proposes, quality, over): labelled documents that pass the base rule.

    ``over`` has, for each rule in order, how many of its cutoffs the document exceeds.
    """
    truth = labels.select(F.col("doc_id").alias("_key"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    m = F.col("m")

    def exceeded(rule: str, value: Column) -> Column:
        cuts = F.array(*[F.lit(float(c)) for c in sorted(rules.cutoffs[rule])])
        return F.size(F.filter(cuts, lambda cut: value > cut))

    over = [exceeded(r, v) for r, v in _values(m, rules).items()]
    rows = measured.where(~base_failed(m, rules)).select(F.col("doc_id").alias("_key"), _stratum("lang").alias("stratum"), F.array(*over).alias("over"))
    return rows.join(truth, "_key").select("stratum", proposing("_key").alias("proposes"), "quality", "over")


def _grid(rules: Rules) -> Column:
    """All (place of the rule, rank of the cutoff among the rule's, rule, cutoff)."""
    cells = [(i, rank, r, float(c)) for i, (r, cuts) in enumerate(rules.cutoffs.items()) for rank, c in enumerate(sorted(cuts), 1)]
    names = ("place", "level", "rule", "cutoff")
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, c, strict=True)]) for c in cells])


def proposed(counted: DataFrame, rules: Rules) -> DataFrame:
    """(stratum, position, place, level, rule, cutoff): the row of cutoffs of each stratum, from the third that proposes."""
    each = counted.where("proposes").select("stratum", "quality", "over", "n", F.inline(_grid(rules)))
    hit = F.get("over", F.col("place")) >= F.col("level")
    both = each.groupBy("stratum", "place", "level", "rule", "cutoff").agg(
        F.sum(F.when(hit, F.col("quality") * F.col("n")).otherwise(0)).alias("k_good"),
        F.sum(F.when(hit, (1 - F.col("quality")) * F.col("n")).otherwise(0)).alias("k_bad"),
    )
    gain = F.col("k_bad") - rules.good_weight * F.col("k_good")
    order = W.partitionBy("stratum").orderBy("k_good", F.desc("gain"), "rule", F.desc("cutoff"))
    row = both.withColumn("gain", gain).where("gain > 0").withColumn("position", F.row_number().over(order))
    return row.select("stratum", "position", "place", "level", "rule", "cutoff")


def tested(measured: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """(stratum, position, rule, cutoff, n_good, k_good, safe): every proposed cutoff and what the holdout says.

    ``k_good`` are the good documents of the holdout that this cutoff or one before it rejects.  ``measured`` is a stored
    table of doc_id, lang and the struct m.  Documents are first counted by what they exceed, so that all that follows
    works on counts of a bounded number of cases a stratum.
    """
    held = held_documents(measured, labels, rules)
    counted = stored(held.groupBy("stratum", "proposes", "quality", "over").agg(F.count("*").alias("n")), "quality-counts")
    row = stored(proposed(counted, rules), "quality-row")
    good = counted.where("not proposes and quality = 1")
    n_good = good.groupBy("stratum").agg(F.sum("n").alias("n_good"))
    # a case is rejected by the first cutoff of the row that it exceeds
    whole = row.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("position", "place", "level"))).alias("row"))
    first = F.filter("row", lambda x: F.get("over", x["place"]) >= x["level"])
    met = good.join(whole, "stratum").withColumn("position", F.get(first, F.lit(0))["position"]).where("position is not null")
    rejected = met.groupBy("stratum", "position").agg(F.sum("n").alias("more"))
    so_far = W.partitionBy("stratum").orderBy("position")
    summed = row.join(rejected, ["stratum", "position"], "left").join(n_good, "stratum")
    summed = summed.withColumn("k_good", F.sum(F.coalesce("more", F.lit(0))).over(so_far))
    n_strata = max(1, counted.select("stratum").distinct().count())
    bound = F.when(F.col("k_good") >= F.col("n_good") * rules.risk, F.lit(1.0)).otherwise(tail(F.col("n_good"), F.col("k_good"), rules.risk))
    safe = F.min((bound <= rules.delta / n_strata).cast("int")).over(so_far) == 1
    return summed.withColumn("safe", safe).select("stratum", "position", "rule", "cutoff", "n_good", "k_good", "safe")


def cutoffs(measured: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """(stratum, cuts): for each stratum the strictest cutoff taken over of each rule."""
    taken = tested(measured, labels, rules).where("safe").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return taken.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))


def kept(m: Column, cuts: Column, rules: Rules) -> Column:
    """Whether measures pass the base rule and all cutoffs of their stratum."""
    passes = ~base_failed(m, rules)
    for rule, value in _values(m, rules).items():
        passes = passes & ~F.coalesce(value > cuts[rule], F.lit(False))
    return passes


def _beside_cutoffs(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows with lang beside the cutoffs of their stratum, a stored table; Spark sends it to all tasks if it is small."""
    return rows.withColumn("stratum", _stratum("lang")).join(chosen, "stratum", "left")


def _measured(docs: DataFrame, rules: Rules) -> DataFrame:
    return stored(docs.select("doc_id", "lang", measures(F.col("text"), rules).alias("m")), "quality-measures")


def verdicts(docs: DataFrame, labels: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Measures and verdict of every document.  Measures are made once and stored without the text."""
    rules = rules or Rules()
    measured = _measured(docs, rules)
    chosen = stored(cutoffs(measured, labels, rules), "quality-cutoffs")
    m = F.col("m")
    out = _beside_cutoffs(measured, chosen)
    return out.select("doc_id", *[m[c].alias(c) for c in MEASURES[:5]], base_failed(m, rules).alias("base_failed"), kept(m, F.col("cuts"), rules).alias("kept"))


def _labelled(docs: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """The documents that have a label; all of them if there are too many labels to be sent to every task."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    few = ids.limit(rules.sent_ids + 1).count() <= rules.sent_ids
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if few else docs


def filtered(docs: DataFrame, labels: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that are kept, with their own columns; cutoffs come from the labelled ones among them.

    Only labelled texts are measured for the cutoffs, without shuffling them, and all texts once for the verdict.
    """
    rules = rules or Rules()
    known = _measured(_labelled(docs.select("doc_id", "lang", "text"), labels, rules), rules)
    chosen = stored(cutoffs(known, labels, rules), "quality-cutoffs")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("lang"))
    rows = _beside_cutoffs(rows, chosen)
    rows = rows.where(let(measures(F.col("_row")["text"], rules), lambda m: kept(m, F.col("cuts"), rules)))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
