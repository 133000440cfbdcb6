"""Licence scan by canonical digests.

Documents are put in canonical form (lower case, owner lines left out, punctuation as blanks, equivalent spellings as
one, single blanks) and hash-joined with the digests of known texts: the whole document (scope ``text``), each of its
lines (``line``), and, for known texts of at least ``least_run`` words, the run of as many words from the beginning of
any line on (``run``), so a licence in the midst of other text is found however its lines are wrapped.  Only beginnings
that have the first words of a known text are digested.  Of a line that says who holds the rights and then goes on with
terms ("(c) 2020 X. Released under ...") only the first part is left out.

Null and blank texts, and texts of nothing but owner lines, match nothing.  Repeated rows are reported once each
with their counts added; a null id stays null; two licences of one digest are both reported; extra columns are ignored;
an empty table or an empty list of known texts gives no rows; texts of any length are scanned whole.  A run that is a
whole line, or stands in a document that is a known text as a whole, is reported as that only.
All of it is column expressions and a join; the known texts are a fixed list of this package, longer ones by digest, or
a table of the caller, which Spark broadcasts only below its own limit and of which the driver sees first words and sizes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import let, stored
from trailmark.llm.licence_texts import DIGESTS, KNOWN, SPELLINGS

#: Beginning of a line that says who holds the rights, and the words with which terms may follow in the same line.
OWNER = r"^[^a-z0-9]*(?:copyright\b|\(c\)|©|all rights reserved)"
TERMS = r"(?:released|licensed|licenced|permission|redistribution|distributed|provided|available|use of|this)"
#: Words of a known text that are looked for first, and least size of a text that may stand inside of others.
HEAD, LEAST_RUN = 4, 40


def spelt(plain: Column) -> Column:
    """Canonical words with one spelling for each."""
    out = plain
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{pattern}\b", spelling)
    # the spellings need a look only at texts that have one of them
    return F.when(plain.rlike("|".join(sorted({p for p, _ in SPELLINGS}))), out).otherwise(plain)


def canonical_line(line: Column) -> Column:
    """A line in canonical form; a line that only says who holds the rights is empty."""
    low = F.lower(line)
    terms = F.regexp_replace(low, rf"{OWNER}.*?[.]\s+({TERMS}\b)", "$1")
    told = F.when(low.rlike(OWNER), F.when(terms != low, terms).otherwise("")).otherwise(low)
    return spelt(F.trim(F.regexp_replace(told, r"[^\p{L}\p{N}]+", " ")))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that are not empty, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def canonical_text(lines: Column) -> Column:
    """Canonical lines as one text, whose spelling does not depend on where lines end."""
    return spelt(F.array_join(lines, " "))


def units(text: Column, heads: list[str], sizes: list[int]) -> Column:
    """(digest, scope, inside) of what in the text may be a known one: all of it, its lines, runs of ``sizes`` words.

    ``inside`` is the digest of the whole text a run stands in.
    """
    begins = "^(?:" + "|".join(sorted(map(re.escape, heads))) + ")\\b"
    kind = "array<struct<digest:string,scope:string,inside:string>>"
    none = F.array().cast(kind)

    def unit(value: Column, scope: str, inside: Column | None = None) -> Column:
        whole = F.lit(None).cast("string") if inside is None else inside
        return F.struct(F.md5(value).alias("digest"), F.lit(scope).alias("scope"), whole.alias("inside"))

    def runs(found: Column, at: Column, inside: Column) -> Column:
        def cut(words: Column) -> Column:
            line = F.size(F.split(F.get(found, at), " "))
            fits = F.filter(F.array(*map(F.lit, sizes)), lambda n: (n <= F.size(words)) & (n != line))
            return F.transform(fits, lambda n: unit(F.array_join(F.slice(words, F.lit(1), n), " "), "run", inside))

        return let(F.split(canonical_text(F.slice(found, at + 1, F.size(found))), " "), cut)

    def made(found: Column) -> Column:
        start = lambda i: F.array_join(F.slice(found, i + 1, F.lit(HEAD)), " ").rlike(begins)
        starts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), start)
        each = F.transform(F.filter(found, lambda x: x.rlike(begins)), lambda x: unit(x, "line"))
        whole = F.when(F.array_contains(starts, F.lit(0)), F.array(unit(canonical_text(found), "text"))).otherwise(none)
        inside = lambda w: F.flatten(F.transform(starts, lambda i: runs(found, i, w)))
        longer = F.when(F.size(starts) > 0, let(F.md5(canonical_text(found)), inside)).otherwise(none) if sizes else none
        return F.when(F.size(found) > 0, F.concat(whole, each, longer)).otherwise(none)

    return let(canonical_lines(text), made)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, licence, head, size): of the given table (licence, text), or of the list of this package."""
    texts = known
    if known is None:
        listed = F.array(*[F.struct(F.lit(i).alias("licence"), F.lit(t).alias("text")) for i, t in KNOWN])
        texts = spark.range(1).select(F.inline(listed))
    made = texts.select(canonical_text(canonical_lines(F.col("text"))).alias("t"), "licence").where("t <> ''")
    words = F.split("t", " ")
    made = made.select(F.md5("t").alias("digest"), "licence", F.array_join(F.slice(words, 1, HEAD), " ").alias("head"), F.size(words).alias("size"))
    if known is None:
        names = ("licence", "size", "head", "digest")
        long = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, d, strict=True)]) for d in DIGESTS])
        made = made.unionByName(spark.range(1).select(F.inline(long)))
    return made.distinct()


def scan(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, licence, scope, n): which known texts the document is, has as a line or has inside, and how often."""
    texts = stored(known_digests(docs.sparkSession, known), "licences")
    listed = texts.select("head", "size").distinct().collect()  # no more than known texts
    if not listed:
        return docs.select(F.col(key).alias("doc_id"), F.lit("").alias("licence"), F.lit("").alias("scope"), F.lit(0).cast("bigint").alias("n")).where("false")
    found = units(F.col(text), sorted({r["head"] for r in listed}), sorted({r["size"] for r in listed if r["size"] >= least_run}))
    opened = docs.select(F.col(key).alias("doc_id"), F.inline(found))
    hits = opened.join(texts.select("digest", "licence").distinct(), "digest")
    part = hits.join(texts.select(F.col("digest").alias("inside")).distinct(), "inside", "left_anti")
    return part.groupBy("doc_id", "licence", "scope").agg(F.count("*").alias("n"))
