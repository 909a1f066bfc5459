"""Token ids of whole corpora by a public byte-level BPE vocabulary (problem 6).

The distinct words of a batch of texts are laid out as a trie, and a depth-first
walk gives every prefix the last token of its encoding. As the encoding of a
prefix is the encoding of what comes before that token, followed by the token,
a prefix that many words share is encoded once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value, to equal that of the public vocabulary: how a text is cut into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words whose encoding a worker keeps between batches. When there are more the store starts anew; that costs time only.
KEPT_WORDS = 400_000
#: Bytes of text whose words are laid out together.
TEXT_AT_ONCE = 8_000_000


def vocabulary_file(name: str = VOCABULARY, folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


class Encoder:
    """Ranks are the ids; the pair of lowest rank merges first, the leftmost of equals."""

    def __init__(self, vocabulary: bytes, pattern: str = WORDS, kept_words: int = KEPT_WORDS) -> None:
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.tokens = {i: t for t, i in self.ids.items()}
        ends: dict[int, set[int]] = {}
        for token in self.ids:
            ends.setdefault(token[-1], set()).add(len(token))
        #: By last byte the lengths of the tokens that end with it, longest first.
        self.lengths = {byte: sorted(lengths, reverse=True) for byte, lengths in ends.items()}
        self.pattern = regex.compile(pattern)
        self.words = self.pattern.findall
        self.kept: dict[str, bytes] = {}  # ids as int32
        self.kept_words = kept_words
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int]] = {}

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into this one; itself twice if none do."""
        known = self.splits.get(token)
        if known is None:
            data, ids, known = self.tokens[token], self.ids, (token, token)
            for at in range(1, len(data)):
                left, right = ids.get(data[:at], token), ids.get(data[at:], token)
                if left < token and right < token and self._stay(left, right, token):
                    known = (left, right)
                    break
            self.splits[token] = known
        return known

    def _stay(self, left: int, right: int, below: int) -> bool:
        """Whether no merge into a token before ``below`` happens across the border of the two tokens.

        Their merges are undone from the last one on. The halves that then meet at
        the border must not merge before the merge that was undone came.
        """
        ids, tokens = self.ids, self.tokens
        while True:
            if ids.get(tokens[left] + tokens[right], below) < below:
                return False
            undone_left, undone_right = self._split(left)[1], self._split(right)[0]
            # of two merges of one rank the left one comes first
            if undone_left != left and (left > right or undone_right == right):
                below, left = left, undone_left
            elif undone_right != right:
                below, right = right + 1, undone_right
            else:
                return True

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are where they meet: then, and only then, an encoding can hold them side by side."""
        known = self.adjacent.get((left, right))
        if known is None:
            known = self.adjacent[left, right] = self._stay(left, right, 1 << 60)
        return known

    def _last_token(self, word: bytes, end: int, last: list[int]) -> int:
        """The one token that the encoding of ``word[:end]`` ends with, given those of the shorter prefixes."""
        ids = self.ids
        for length in self.lengths.get(word[end - 1], ()):
            start = end - length
            if start < 0:
                continue
            token = ids.get(word[start:end])
            if token is not None and (start == 0 or self.may_follow(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def learn(self, words: Iterable[str]) -> None:
        """Encodes the words not yet kept, by one walk over their trie.

        The trie is the sorted list of words: a node is a prefix that neighbours
        share, and going on from one word to the next keeps the states of the
        shared part and drops those below it.
        """
        if len(self.kept) > self.kept_words:
            self.kept = {}
        if len(self.adjacent) > 4 * self.kept_words:
            self.adjacent = {}
        fresh = sorted((w.encode(), w) for w in words if w not in self.kept)
        before, last = b"", [0]
        for data, word in fresh:
            shared, limit = 0, min(len(before), len(data))
            while shared < limit and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                last.append(self._last_token(data, end, last))
            out, at = [], len(data)
            while at:
                out.append(last[at])
                at -= len(self.tokens[last[at]])
            self.kept[word] = np.array(out[::-1], np.int32).tobytes()
            before = data

    def encode_runs(self, texts: list[str | None], at_once: int = TEXT_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of one run of texts after the other, about ``at_once`` characters each, the ids of all and where those of each text end; none for a null or empty one."""
        at = 0
        while at < len(texts):
            size, until = 0, at
            while until < len(texts) and (until == at or size + len(texts[until] or "") <= at_once):
                size += len(texts[until] or "")
                until += 1
            cut = [self.words(t) if t else [] for t in texts[at:until]]
            self.learn({w for words in cut for w in words})
            of = self.kept.__getitem__
            encoded = [b"".join(map(of, words)) for words in cut]
            ends = np.zeros(len(cut) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in encoded], out=ends[1:])
            yield np.frombuffer(b"".join(encoded), np.int32), ends
            at = until

    def encode_many(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text."""
        for ids, ends in self.encode_runs(texts):
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield ids[a:b].tolist()


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def encoder_on_workers(spark: SparkSession, name: str = VOCABULARY, folder: str = TOKENIZERS) -> Callable[[], Encoder]:
    """What a task calls for its encoder. The vocabulary file (under 1 MB, of fixed size) goes to the workers as a broadcast, so only the driver needs it."""
    shared = spark.sparkContext.broadcast(vocabulary_file(name, folder))
    return lambda: _encoder(shared.value)


def _encode(get: Callable[[], Encoder]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            done = 0
            for ids, ends in encoder.encode_runs(batch.column(1).to_pylist()):
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[done : done + len(lists)], lists], ["doc_id", "ids"])
                done += len(lists)

    return run


def encoded(documents: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, ids)`` of each row; the text is taken as it is, without special tokens.

    Empty and null texts have an empty list. Strings that look like special tokens
    are ordinary text. Repeated rows are kept; other columns are not read. No shuffle.
    """
    get = encoder_on_workers(documents.sparkSession, name, folder)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encode(get), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, tokens)``: the length of each row's encoding."""
    get = encoder_on_workers(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            ends = [np.diff(ends).astype(np.int64) for _, ends in encoder.encode_runs(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(ends or [np.zeros(0, np.int64)]))], ["doc_id", "tokens"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, tokens bigint")


def decoded(documents: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, text)``: the text that the ids of each row of ``encoded`` stand for, to hold against the original."""
    get = encoder_on_workers(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = get().tokens
        for batch in batches:
            texts = [b"".join([tokens[i] for i in ids]).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded(documents, name, folder).mapInArrow(run, "doc_id bigint, text string")
