"""Sizes of texts in tokens of a public tokenizer."""
from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Ranks of a public 50k byte-level BPE vocabulary; the path must hold on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY = 50_257
# fixed value of that vocabulary: how it splits text before merging bytes
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str = TOKENIZER) -> tiktoken.Encoding:
    """The tokenizer of a rank file, once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# fixed values: the characters that \s means in the pattern. Its lookahead recurses once a character, so the library
# fails on runs of some ten thousand
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}+")


@lru_cache(2)
def encoder(path: str = TOKENIZER) -> Callable[[str], list[int]]:
    """Token ids of a text of any length, long runs of blanks included.

    By the pattern a run of blanks is one piece without its last character, which goes with what follows, or as a whole
    at the text's end. Long runs are taken out by that rule and encoded as the single piece they are.
    """
    e = encoding(path)
    plain, piece = e.encode_ordinary, e._encode_single_piece

    def encode(text: str) -> list[int]:
        if len(text) < 1000 or LONG_BLANKS.search(text) is None:
            return plain(text)
        out, at = [], 0
        for m in LONG_BLANKS.finditer(text):
            end = m.end() - (m.end() < len(text))
            if m.start() > at:
                out += plain(text[at : m.start()])
            out += piece(text[max(at, m.start()) : end])
            at = end
        return out + plain(text[at:])

    return encode


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens of every row; NULL and empty texts have 0. Special-token strings count as ordinary text."""
    return docs.select("doc_id", "text").mapInArrow(_count(path), "doc_id bigint, tokens bigint")
