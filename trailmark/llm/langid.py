"""Language identification in two steps: the family, then one-versus-one machines inside it.

A text is turned into hashed counts of one to three letters (lower case, words parted by blanks), square-rooted and of
length one.  Linear support vector machines, one for each family against the rest, choose the language family; inside
it one machine for each pair of languages votes.  The score is the family's share of the family margins (softmax) times
the mean certainty of the winner's pairs.

The machines learn from at most ``TRAIN_TEXTS`` texts of each language, those with the smallest hash of doc_id among the
documents that are not held out; of each a short piece is learned from too.  Languages without an entry in the family
table are families of their own.

A text that is null or has no letter is ``und`` with score 0; a null id is not held out; without labelled texts all are
``und``; repeated rows come out each; extra columns, whatever their names, are ignored; an empty table gives no rows; whole
texts are read; equal votes are settled by certainty, and what is equal then goes to the first language or family by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a language to learn from, hash buckets, letters of texts worked on at once, words of the short piece.
TRAIN_TEXTS, BUCKETS, BATCH_LETTERS, PIECE = 300, 4096, 4_000_000, 8
NONE = "und"
#: Languages of each family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn ur mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "celtic": "ga cy br gd",
    "austronesian": "id ms tl jv su",
    "dravidian": "ta te kn ml",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_FACTOR = np.uint32(0x9E3779B1)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def letters(text: str | None) -> str:
    """Letters in lower case, words between single blanks, with a blank at both ends; empty without letters."""
    found = _OTHER.sub(" ", text or "").lower().strip()
    return f" {found} " if found else ""


def vectors(texts: list[str]) -> np.ndarray:
    """One row for each text of ``letters``; rows of empty texts are zero."""
    out = np.zeros((len(texts), BUCKETS), "f4")
    for row, text in enumerate(texts):
        if not text:
            continue
        for a in range(0, len(text), BATCH_LETTERS):
            points = np.frombuffer(text[max(0, a - 2) : a + BATCH_LETTERS].encode("utf-32-le"), "u4")
            skip = min(a, 2)
            one = points * _FACTOR
            two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(31) + one[1:]
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(37) + one[2:]
            for grams, known in ((one, skip), (two, skip - 1), (three, skip - 2)):
                grams = grams[max(0, known) :] if a else grams
                mixed = (grams ^ (grams >> np.uint32(16))) * np.uint32(0x85EBCA6B)
                out[row] += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    out = np.sqrt(out)
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """A linear support vector machine (weights, then bias) for labels +1 and -1, by subgradient steps.

    Both sides weigh the same, however many rows they have.
    """
    x = np.concatenate([x, np.ones((len(x), 1), "f4")], 1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype("f4")
    w, mean = np.zeros(x.shape[1], "f4"), np.zeros(x.shape[1], "f4")
    for t in range(1, rounds + 1):
        inside = (y * (x @ w) < 1).astype("f4")
        w = w - (penalty * w - (inside * weight * y) @ x) * (8 / np.sqrt(t)).astype("f4")
        if t > rounds // 2:
            mean += w / (rounds - rounds // 2)
    return mean


class Tree:
    """Families against the rest, and pairs of languages inside each family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.languages = sorted(set(langs))
        self.families = sorted({family_of(a) for a in self.languages})
        own = np.array([family_of(a) for a in langs])
        self.family = np.stack([machine(x, np.where(own == f, 1.0, -1.0).astype("f4")) for f in self.families]) if len(self.families) > 1 else None
        self.inside: dict[str, tuple[list[str], dict]] = {}
        for f in self.families:
            members = [a for a in self.languages if family_of(a) == f]
            pairs = {}
            for a, b in combinations(members, 2):
                chosen = (langs == a) | (langs == b)
                pairs[a, b] = machine(x[chosen], np.where(langs[chosen] == a, 1.0, -1.0).astype("f4"))
            self.inside[f] = (members, pairs)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row."""
        x = np.concatenate([x, np.ones((len(x), 1), "f4")], 1)
        if self.family is None:
            best, share = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = 2 * np.clip(x @ self.family.T, -15, 15)
            odds = np.exp(margins - margins.max(1, keepdims=True))
            best = odds.argmax(1)
            share = odds.max(1) / odds.sum(1)
        lang, score = np.empty(len(x), object), np.empty(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members, pairs = self.inside[f]
            votes, certain = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (a, b), w in pairs.items():
                m = 1 / (1 + np.exp(-2 * np.clip(x[rows] @ w, -15, 15)))
                for name, value in ((a, m), (b, 1 - m)):
                    votes[:, members.index(name)] += value > 0.5
                    certain[:, members.index(name)] += value
            mean = certain / max(1, len(members) - 1)
            won = (votes + mean / 2).argmax(1)
            lang[rows] = [members[i] for i in won]
            score[rows] = share[rows] * (mean[np.arange(len(rows)), won] if pairs else 1.0)
        return lang, np.clip(score, 0, 1)


def _held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Tree | None:
    """The machines, learned from a bounded sample; None without labelled texts."""
    known = docs.where(~_held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as languages
    if not counts:
        return None
    # a share of each language by hash, twice as large as needed on average, then the smallest hashes
    limit = {a: min(1.0, 2 * TRAIN_TEXTS / n + 20 / n) * 2.0**64 - 2.0**63 for a, n in counts.items()}
    limits = F.create_map(*[F.lit(v) for pair in limit.items() for v in pair])
    sample = rows.where(F.col("h").cast("double") <= limits[F.col("lang")]).toPandas()  # a few times TRAIN_TEXTS for each language
    sample = sample.sort_values("h").groupby("lang").head(TRAIN_TEXTS)
    texts = [letters(t) for t in sample.text]
    pieces = [f" {' '.join(t.split()[:PIECE])} " for t in texts]
    return Tree(vectors(texts + pieces), np.array([*sample["lang"], *sample["lang"]]))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; lang is read only to learn from."""
    tree = trained(docs, key, text, lang)

    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 1000):
                part = frame.iloc[a : a + 1000]
                found = [letters(t) for t in part.text]
                langs, score = tree.predict(vectors(found)) if tree else (np.full(len(part), NONE, object), np.zeros(len(part)))
                bare = np.array([not t for t in found], bool)
                langs[bare], score[bare] = NONE, 0.0
                yield pd.DataFrame({"doc_id": part.doc_id, "held_out": part.held_out, "lang_pred": langs, "score": score})

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), _held_out(key).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInPandas(predicted, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
