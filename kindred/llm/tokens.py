"""Token counts of whole texts under a byte-level BPE vocabulary.

Which vocabulary strings the library itself turns into one token, as a pre-token of their
own, is found out once, on the driver. Such pre-tokens count one; only the rest is merged by
the library, each distinct one once per task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: How the byte-level pre-tokenizer splits a text (fixed by the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct merged pre-tokens that a task remembers at most; then it starts anew.
REMEMBERED = 500_000
#: Texts of more characters are split by an iterator, so that no list of all pre-tokens is held.
LONG = 1_000_000


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and one token when they stand alone."""
    strings = [s for s in (tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size())) if s and "�" not in s]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1 and len(split(s)) == 1)


class Counter:
    """Counts tokens of single texts; made once per worker process."""

    def __init__(self, vocabulary: str, whole: frozenset[str]):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.pattern = regex.compile(PATTERN)
        self.known = dict.fromkeys(whole, 1)
        self.whole = whole
        self.usual: set[str] = set()  # characters that both splitters put in one class
        self.odd: set[str] = set()
        self.plain = self._alike({chr(i) for i in range(128)})

    def _alike(self, chars: set[str]) -> bool:
        """Whether the pattern splits around all these characters as the library does."""
        for c in chars - self.usual - self.odd:
            probe = f"a{c}b{c}1{c}!{c} {c}{c}x"
            spans = [m.span() for m in self.pattern.finditer(probe)]
            own = [s for _, s in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            (self.usual if spans == own else self.odd).add(c)
        return chars.isdisjoint(self.odd)

    def _library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not (self.plain and text.isascii()) and not self._alike(set(text)) or any(s in text for s in self.special):
            return self._library(text)
        pieces = self.pattern.findall(text) if len(text) <= LONG else (m[0] for m in self.pattern.finditer(text))
        total, known = 0, self.known
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) > REMEMBERED:
                    self.known = known = dict.fromkeys(self.whole, 1)
                n = known[p] = self._library(p)
            total += n
        return total


@lru_cache(1)
def _counter(vocabulary: str, whole: frozenset[str]) -> Counter:
    return Counter(vocabulary, whole)


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_bytes, n_tokens (long), over_limit (n_tokens > limit).

    Counts are those of the library for the vocabulary file (byte-level BPE, JSON), without
    added tokens; special strings inside texts count as its default has it. A null or
    empty text has 0 of each. Repeated rows are counted each for itself, an empty table gives
    an empty one, further columns are ignored. Nothing is shuffled; the vocabulary (2 MB) is
    broadcast. A text with characters that the two splitters class differently is left whole to the library.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(Tokenizer.from_str(vocabulary))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for b in batches:
            n = [counter.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return (read.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
