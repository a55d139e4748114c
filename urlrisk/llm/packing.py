"""Best-fit packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import light_batches, utf8

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, tokens binary, sequence_id bigint, offset bigint"
#: Words whose ids a worker remembers; beyond it forgets them all. Only speed depends on it.
REMEMBERED = 250_000
_encoders: dict[str, Encoder] = {}


def _raw(token: str) -> bytes:
    """The bytes that a byte-level vocabulary entry stands for: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    return bytes(_BYTES[c] for c in token)


_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PLAIN} | {
    chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern starts a token at a single space between two non-space characters and makes
    a single line feed between two such characters a token of its own. So a text with no other white
    space is encoded word by word, each new word once; any other text is encoded whole by the tokenizer.
    New words go through the same vocabulary and merges as one text with line feeds between them, which
    tiktoken encodes several times faster; the tests hold both against the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")
        ranks = {_raw(t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.words = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.feed = self.words.encode_ordinary("\n")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Of strings without line feeds that are not empty."""
        ids = np.array(self.words.encode_ordinary("\n".join(words)), "<u4")
        ends = np.flatnonzero(ids == self.feed[0]).tolist()
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True)]

    def _learn(self, known: dict[str, bytes], words: set[str], before: str) -> None:
        new = [w for w in words if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(words)
        if new:
            known.update(zip(new, self._word_ids([before + w for w in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        lines = [t.split("\n") if " ".join(t.split()) == t.replace("\n", " ") and not self.added.search(t) else None for t in texts]
        heads: set[str] = set()
        tails: set[str] = set()
        words = [None if own is None else [line.split(" ") for line in own] for own in lines]
        for own in words:
            for line in own or ():
                heads.add(line[0])
                tails.update(line[1:])
        heads.discard("")  # an empty text
        self._learn(self.first, heads, "")
        self._learn(self.later, tails, " ")
        self.first[""] = b""
        first, later, feed = self.first, self.later.__getitem__, np.array(self.feed, "<u4").tobytes()
        whole = iter(self._ids([t for t, own in zip(texts, lines, strict=True) if own is None]))
        return [
            next(whole) if own is None
            else feed.join([first[line[0]] + b"".join(map(later, line[1:])) for line in own])
            for own in words
        ]


class OpenBins:
    """A fixed number of open sequences; bit f of an integer says that one with free space f is open."""

    def __init__(self, capacity: int, most: int, first_id: int) -> None:
        self.capacity, self.most, self.ids = capacity, most, itertools.count(first_id)
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        bin_id = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The sequence with the least free space that fits, and the offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id = self.capacity, next(self.ids)
        if left := free - length:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.count += 1
        return bin_id, self.capacity - free


def pack(
    docs: DataFrame, capacity: int = 1024, open_bins: int = 512, end_id: int = 2, tokenizer: str | None = None
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens: one row per piece (SCHEMA).

    A document is its token ids (null text: none) and ``end_id``. Only longer ones are cut, into pieces of
    ``capacity`` tokens, of which the first may be shorter; full pieces are sequences of their own. Each
    task packs the pieces of its input in order: a piece goes to the open sequence with the least free
    space that fits; if none does a new one opens, and beyond ``open_bins`` the fullest closes. A full
    one closes at once. A task's state is bounded, nothing is shuffled, and sequence ids carry the task's
    number, so a task that runs again gives the same rows. ``tokenizer`` is a path that executors have; by
    default the installed byte-level vocabulary.

    Repeated rows are packed each, null ids are kept, and an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 36)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                texts = ["" if t is None else t.decode() for t in part["_text"]]
                rows = []
                for doc_id, ids in zip(part["doc_id"], _encoders[path].encode(texts), strict=True):
                    ids += end
                    total = len(ids) // 4
                    cut = total % capacity or capacity
                    start = 0
                    for piece in itertools.count():
                        length = cut - start
                        rows.append((doc_id, piece, start, length, ids[4 * start:4 * cut], *bins.place(length)))
                        start, cut = cut, cut + capacity
                        if start >= total:
                            break
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "tokens", "sequence_id", "offset"])

    light_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint"), utf8("text").alias("_text"))
    return narrow.mapInPandas(run, SCHEMA)


def op7_packing(spark, sf_dir):
    return pieces_digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their tokens."""
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")
