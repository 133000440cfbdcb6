"""BPE encoding and decoding by a table of distinct words.

Texts are split into words in Spark tasks, every distinct word is encoded once for the whole corpus, and its
ids are joined back by position.  Decoding joins ids with their pieces.

Null and empty texts have no tokens and decode to the empty string; repeated rows and null keys come back as
they are; extra columns are ignored; an empty table gives no rows; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.blocks import Block, blocks, by_word, with_answers
from trailmark.llm.common import pack, unpack

#: Fixed value: the pattern by which the byte-level vocabularies split texts into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class depends on the Unicode version (found by probing all of them) and all beyond the basic
#: plane: runs of text that hold one are split by the vocabulary's own splitter.
UNSETTLED = regex.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7c0-\ua7ff\uab60-\uab6f\U00010000-\U0010ffff]"
)
#: Words of a block: large blocks send a word less often.
BLOCK_WORDS = 10_000_000
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=2)
def specials(path: str) -> list[str]:
    """Texts the vocabulary holds as tokens of their own, wherever they stand."""
    return sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=lambda s: (-len(s), s))


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """Bytes of every id: the right side of the id-to-piece join, as long as the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    tokenizer = _tokenizer(path)
    found = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in found]


@lru_cache(maxsize=2)
def _patterns(path: str):
    kept = specials(path)
    return regex.compile(WORD_PATTERN).findall, regex.compile("(" + "|".join(map(regex.escape, kept)) + ")").split if kept else None, kept


def split_words(text: str, path: str) -> list[str]:
    """The text's words; joined they are the text."""
    find, cut, kept = _patterns(path)
    if UNSETTLED.search(text):
        find = lambda x: [x[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(x)]
    if not any(s in text for s in kept):
        return find(text)
    return [w for i, x in enumerate(cut(text)) for w in ([x] if i % 2 else find(x))]


def encode_words(found: list[bytes], path: str) -> list[list[int]]:
    """Ids of each word."""
    tokenizer = _tokenizer(path)
    made = []
    for at in range(0, len(found), 20_000):
        batch = [w.decode() for w in found[at : at + 20_000]]
        made += [e.ids for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
    return made


def _answer(path: str):
    def answer(found: list[bytes], uses: list[np.ndarray], _: list) -> list[bytes]:
        ids = encode_words(found, path)
        out = []
        for use in uses:
            own = [ids[i] for i in use.tolist()]
            sizes = pack(np.fromiter(map(len, own), "i4", len(own)))
            out.append(len(sizes).to_bytes(8, "little") + sizes + pack(np.array([x for y in own for x in y], "i4")))
        return out

    return answer


def _ids(blob: bytes) -> list[list[int]]:
    blob = bytes(blob)
    cut = 8 + int.from_bytes(blob[:8], "little")
    ends = np.cumsum(unpack(blob[8:cut], "i4"), dtype="i8").tolist()
    flat = unpack(blob[cut:], "i4").tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _map_blocks(docs: DataFrame, path: str, finish, schema: str, key: str, text: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    made = blocks(docs, lambda t: split_words(t, path), key, text, most_words=block_words)

    def in_order(block: Block, blobs: list[bytes], order: np.ndarray) -> pd.DataFrame:
        ids: list = [None] * len(order)
        for i, found in zip(order.tolist(), (x for b in blobs for x in _ids(b)), strict=True):
            ids[i] = found
        return finish(block, ids)

    return with_answers(made.drop("words"), by_word(made, _answer(path)), in_order, schema)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): token ids of every text."""

    def finish(block: Block, ids: list[list[int]]) -> pd.DataFrame:
        rows = [[x for c in block.codes[a:b].tolist() for x in ids[c]] for a, b in zip(block.starts, block.ends, strict=True)]
        return pd.DataFrame({key: pd.Series(block.ids, dtype="Int64"), "ids": rows})

    return _map_blocks(docs, path, finish, f"{key} bigint, ids array<int>", key, text)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the pieces of the ids joined; a null list is the empty text, bytes that are no UTF-8 are replaced."""

    def joined(frames):
        piece = pieces(path)
        for frame in frames:
            texts = [b"".join([piece[i] for i in row]).decode("utf-8", "replace") if row is not None else "" for row in frame[ids]]
            yield pd.DataFrame({key: frame[key], "text": texts})

    # keys as text, so that large ones stay exact beside nulls
    rows = encoded.select(F.col(key).cast("string").alias(key), ids).mapInPandas(joined, f"{key} string, text string")
    return rows.withColumn(key, F.col(key).cast("bigint"))


def digests(docs: DataFrame, path: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the text decoded from them, for every document.

    Blocks of fewer words need less memory and more disk.
    Ids and decoded bytes are made once a distinct word of a block and joined by position.
    """

    def finish(block: Block, ids: list[list[int]]) -> pd.DataFrame:
        piece = pieces(path)
        sizes = np.fromiter(map(len, ids), "i8", len(ids))
        listed = [",".join(map(str, x)) for x in ids]
        spelt = [b"".join([piece[i] for i in x]) for x in ids]
        n, of_ids, of_text = [], [], []
        for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            codes = block.codes[a:b]
            own = codes.tolist()
            n.append(int(sizes[codes].sum()))
            of_ids.append(hashlib.sha256(",".join([listed[c] for c in own]).encode()).hexdigest())
            text = b"".join([spelt[c] for c in own])
            of_text.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
        return pd.DataFrame({"doc_id": pd.Series(block.ids, dtype="Int64"), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text})

    return _map_blocks(docs, path, finish, DIGESTS, "doc_id", "text", block_words)
