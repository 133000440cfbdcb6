"""Line dedup by a tree of line templates.

A line's place in the tree is fixed by its number of words and its first words; words with a digit, addresses and links
are variable fields there.  A leaf holds the line's template: its words with the variable fields left open.  Longer
lines also stand under templates with one region open, the rest of the line being cut into ``regions``, so that a line
that differs only in one such field is an instance of the same template.  A region is open only if it has no more than
``most_open_words`` words, so no more than these go with a line that is dropped for the rest of it.  A template seen in
at least two documents is recurring: its lines stay in the document with the smallest id and are dropped from all others.

Fields are open only in templates that keep at least ``least_words`` literal words.  A line with fewer of them, such as
a row of numbers, dates or ids, stands under its real words alone, and recurs only where the very same line does.

A line of fewer than ``least_words`` words recurs by chance.  It stands under its real words and is recurring if at least
``least_documents`` documents and a share of ``common_share`` of all have it: menu entries, footers, notices.  Open
regions are tried from ``least_open_words`` words.

Documents that lose all their lines with words go.  Null and empty texts have no lines and stay as they are; rows with
the same id count as one document; rows without id count as one document that comes last; equal lines inside one
document recur only if another document has them; of several rows with the smallest id all keep their lines; extra
columns, whatever their names, are kept as they are; an empty table stays empty; texts of any length are cut whole.
Only hashes and positions are shuffled to find the templates, first combined in each task, so a line that stands in a
third of all documents leaves one row a task; where hashes meet their templates again, both sides are stored tables that
are dealt by the hash, of which Spark splits the large ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import let, stored, words

_LAST = (1 << 63) - 1
_FIELD, _OPEN = "[0-9@]|://", "<*>"


@dataclass(frozen=True)
class Tree:
    leading: int = 2
    regions: int = 4
    least_words: int = 5
    least_open_words: int = 10
    most_open_words: int = 4
    least_documents: int = 10
    common_share: float = 0.005


def masked(line: Column) -> Column:
    """The line with variable fields open: words with a digit, addresses, links."""
    field = r"[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*"
    return F.when(line.rlike(_FIELD), F.regexp_replace(line, field, _OPEN)).otherwise(line)


def literals(found: Column) -> Column:
    """Number of words that are no open field."""
    return F.size(F.filter(found, lambda w: w != _OPEN))


def template_keys(line: Column, tree: Tree) -> Column:
    """Hashes of the templates the line stands under: the whole one first, then those with one region open."""

    def keys(found: Column) -> Column:
        n, rest = F.size(found), F.size(found) - tree.leading
        path = F.xxhash64(n, F.slice(found, 1, tree.leading))
        cut = lambda r: F.floor(rest * r / tree.regions).cast("int")
        size = lambda r: cut(r + 1) - cut(r)
        region = lambda r: F.slice(found, tree.leading + 1 + cut(r), size(r))
        part = [F.xxhash64(region(r)) for r in range(tree.regions)]

        def joined(p: Column) -> Column:
            whole = F.xxhash64(path, p)
            open_at = [F.xxhash64(path, F.lit(r), *[p[i] for i in range(tree.regions) if i != r]) for r in range(tree.regions)]
            # a line with fields open may have too few literal words outside a region
            short = [F.when(size(r) <= tree.most_open_words, k) for r, k in enumerate(open_at)]
            enough = [F.when(literals(found) - literals(region(r)) >= tree.least_words, k) for r, k in enumerate(short)]
            opened = F.when(F.array_contains(found, _OPEN), F.array(*enough)).otherwise(F.array(*short))
            opened = F.filter(opened, lambda k: k.isNotNull())
            return F.when(n < tree.least_open_words, F.array(whole)).otherwise(F.concat(F.array(whole), opened))

        # of a long line no region is short enough, so only its whole template is worked out
        long = rest > tree.regions * (tree.most_open_words + 1)
        alone = F.array(F.xxhash64(path, F.slice(found, tree.leading + 1, n)))
        return F.when(long, alone).otherwise(let(F.array(*part), joined))

    def exact(found: Column) -> Column:
        path = F.xxhash64(F.lit("exact"), F.size(found))
        return F.when(F.size(found) > 0, F.array(F.xxhash64(path, found))).otherwise(F.array().cast("array<bigint>"))

    few = lambda found: literals(found) < tree.least_words
    return let(words(masked(line)), lambda found: F.when(few(found), exact(words(line))).otherwise(keys(found)))


def is_short(line: Column, tree: Tree) -> Column:
    """Whether a line has too few words to recur only where it is boilerplate."""
    return F.size(words(line)) < tree.least_words


def _document(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST))


def recurring(keyed: DataFrame, n_documents: int, tree: Tree) -> DataFrame:
    """(key, first): the templates that recur and the smallest id that has them, stored.

    ``keyed`` is a stored table of doc, keys and short.
    """
    each = keyed.select("doc", "short", F.explode("keys").alias("key"))
    long = each.where("not short").groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    least = max(tree.least_documents, math.ceil(tree.common_share * n_documents))
    short = each.where("short").groupBy("key", "doc").agg(F.lit(1).alias("one")).groupBy("key").agg(F.min("doc").alias("first"), F.sum("one").alias("n"))
    return stored(long.select("key", "first").unionByName(short.where(F.col("n") >= least).select("key", "first")), "line-recurring")


def dropped_lines(docs: DataFrame, tree: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, at): positions of the lines to drop, as an array for each row that has any; row is ``row_key``."""
    tree = tree or Tree()
    lines = docs.select(row_key(key, text).alias("row"), _document(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    found = template_keys(F.col("line"), tree).alias("keys")
    keyed = stored(lines.select("row", "doc", "at", is_short(F.col("line"), tree).alias("short"), found).where(F.size("keys") > 0), "line-templates")
    seen = recurring(keyed, keyed.select("doc").distinct().count(), tree)
    each = keyed.select("row", "doc", "at", F.explode("keys").alias("key"))
    again = each.join(seen, "key").where("doc > first")
    return again.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("at"))


def row_key(key: str, text: str) -> Column:
    """A key for rows whose id may be null or come twice: rows of one id and one hash of the text are taken for copies."""
    return F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"))


def _beside(docs: DataFrame, tree: Tree | None) -> DataFrame:
    """(_row: the document, lines, at: positions to drop or null)."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), row_key("doc_id", "text").alias("row"))
    gone = dropped_lines(docs, tree).withColumnRenamed("row", "gone")
    return rows.join(gone, F.col("row") == F.col("gone"), "left").select("_row", F.split(F.col("_row")["text"], "\n").alias("lines"), "at")


def _kept(lines: Column, at: Column) -> Column:
    left = F.filter(lines, lambda x, i: ~F.array_contains(at, i))
    return F.when(at.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(left, "\n"))


def cleaned(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """The documents without recurring lines; n_chars, where there is one, is counted anew."""
    rows = _beside(docs, tree).withColumn("text", _kept(F.col("lines"), F.col("at")))
    rows = rows.where(F.col("at").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    anew = {"text": F.col("text"), "n_chars": F.when(F.col("at").isNull(), F.col("_row")["n_chars"] if "n_chars" in docs.columns else None).otherwise(F.length("text"))}
    kinds = dict(docs.dtypes)
    return rows.select(*[(anew[c].cast(kinds[c]) if c in anew else F.col("_row")[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text_md5) of every document; text_md5 is of the text left, an empty one if none."""
    rows = _beside(docs.select("doc_id", "text"), tree)
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    gone = F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("bigint")
    left = F.md5(F.coalesce(_kept(F.col("lines"), F.col("at")), F.lit("")))
    return rows.select(F.col("_row")["doc_id"].alias("doc_id"), n.alias("n_lines"), gone.alias("n_dropped"), left.alias("text_md5"))
