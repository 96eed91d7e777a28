"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match. Every adjacent pair of guessed tokens is then tested, all pairs of
a batch at once: a pair stands if merging its joined bytes would end in the same two tokens. If all pairs of a word stand,
the guess is the exact result. Only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import map_batches, shared

# Fixed values of the byte-level format: how text is cut into words before merging.
WORD_PATTERN = (
    r" ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\p{White_Space}\p{L}\p{N}]++"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

# Words kept by each worker, some 200 bytes each.
REMEMBERED_WORDS = 250_000

# Failing words up to so many bytes are merged together, longer ones one by one with a queue.
TOGETHER_BYTES = 48

NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, as the file's bytes."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser is supported")
        if before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("prefix spaces, other splits and ignored merges are not supported")
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {bytes(of_letter[c] for c in token): i for token, i in model["vocab"].items()}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]

        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes the token
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.ordered = True  # each token has one merge, later than those of its parts
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(of_letter[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            if (x, y) in self.merges or self.born[z] >= 0 or (len(a) > 1 and self.born[x] < 0) or (len(b) > 1 and self.born[y] < 0):
                self.ordered = False
            self.merges.setdefault((x, y), (rank, z))
            self.born[z], self.left[z], self.right[z] = rank, x, y
        self.ordered &= all(self.born[i] >= 0 or len(t) == 1 for t, i in self.ids.items())
        keys = np.array([x * size + y for x, y in self.merges] or [-1], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.array([rank for rank, _ in self.merges.values()] or [NEVER], np.int64)[order]
        self.pair_made = np.array([made for _, made in self.merges.values()] or [0], np.int64)[order]
        self.reach: dict[bytes, int] = {}  # longest token by its first four bytes
        for token in self.ids:
            self.reach[token[:4]] = max(self.reach.get(token[:4], 1), len(token))
        self.split = regex.compile(WORD_PATTERN).findall
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, bytes] = {}  # the ids as 32-bit integers

    def words(self, text: str) -> list[str]:
        if self.marks is None or not any(mark in text for mark in self.special):
            return self.split(text)
        return [w for part in self.marks.split(text) for w in ([part] if part in self.special else self.split(part))]

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, start, end, ids, reach = [], 0, len(word), self.ids, self.reach
        while start < end:
            stop = min(end, start + reach.get(word[start : start + 4], 3))
            while (token := ids.get(word[start:stop])) is None:
                stop -= 1
            out.append(token)
            start = stop
        return out

    def find(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's merge (NEVER if none), and its place in the table."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER), at

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stands.

        Merging is watched backwards in time. The pieces that touch at the boundary are the two tokens, then the one made
        later is taken apart, and so on down to bytes. A pair fails if pieces that touch at some time have a merge that
        comes before the merges that took them away; at equal ranks the left one comes first.
        """
        stands = np.ones(len(x), bool)
        live, end_x, end_y = np.arange(len(x)), np.full(len(x), NEVER), np.full(len(x), NEVER)
        while live.size:
            rank, _ = self.find(x, y)
            clash = (rank < end_x) & (rank <= end_y) & (rank < NEVER)
            stands[live[clash]] = False
            born_x, born_y = self.born[x], self.born[y]
            on = ~clash & ((born_x >= 0) | (born_y >= 0))
            x, y, end_x, end_y, live, born_x, born_y = (v[on] for v in (x, y, end_x, end_y, live, born_x, born_y))
            undo_x = born_x > born_y
            end_x, end_y = np.where(undo_x, born_x, end_x), np.where(undo_x, end_y, born_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return stands

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, in n log n steps."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for u, v in ((before[i], i), (i, after[i])):
                if u >= 0 and v < n and (m := self.merges.get((ids[u], ids[v]))):
                    heapq.heappush(queue, (m[0], u, ids[u], ids[v]))
        return [t for t in ids if t >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words at once: each round does the lowest merge of every word."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        while ids.size:
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank, at = self.find(ids[:-1], ids[1:])
            rank = np.r_[np.where(word[1:] == word[:-1], rank, NEVER), NEVER]
            lowest = np.minimum.reduceat(rank, starts)
            spread = np.repeat(lowest, np.diff(np.r_[starts, ids.size]))
            hit = (rank == spread) & (rank < NEVER)
            # In a run of equal tokens every second pair merges, from the left.
            place = np.arange(ids.size)
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run) % 2 == 0
            done = spread >= NEVER
            if done.any():
                ends = np.flatnonzero(np.r_[True, word[done][1:] != word[done][:-1], True]) if done.any() else []
                finished, owners = ids[done].tolist(), word[done]
                for a, b in zip(ends[:-1], ends[1:]):
                    out[owners[a]] = finished[a:b]
            ids[hit] = self.pair_made[at[np.flatnonzero(hit)]]
            keep = ~np.r_[False, hit[:-1]] & ~done
            ids, word = ids[keep], word[keep]
        return out

    def learn(self, words: set[str]) -> int:
        """Encode words into `known`; returns how many needed exact merging."""
        order = list(words)
        raw = [w.encode() for w in order]
        guesses: list[list[int]] = [self.guess(w) for w in raw] if self.ordered else [[] for _ in raw]
        bad = list(range(len(raw)))
        if self.ordered:
            sizes = np.array([len(g) for g in guesses], np.int64)
            flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
            word = np.repeat(np.arange(len(order)), sizes)
            inside = np.flatnonzero(word[1:] == word[:-1])
            keys, where = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            stands = self.compatible(keys // self.size, keys % self.size)[where]
            bad = np.unique(word[inside[~stands]]).tolist()
        short = [i for i in bad if len(raw[i]) <= TOGETHER_BYTES]
        for i, ids in zip(short, self.merge_many([raw[i] for i in short])):
            guesses[i] = ids
        for i in bad:
            if len(raw[i]) > TOGETHER_BYTES:
                guesses[i] = self.merge(raw[i])
        self.known.update((w, array("i", ids).tobytes()) for w, ids in zip(order, guesses))
        return len(bad)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, the ids as 32-bit integers."""
        split = [self.words(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known.clear()
            new = set(chain.from_iterable(split))
        new.difference_update(self.special)
        self.learn(new)
        self.known.update({mark: array("i", [i]).tobytes() for mark, i in self.special.items()})
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(sent) -> Vocabulary:
    if sent.value[0] not in _LOADED:
        _LOADED.clear()
        _LOADED[sent.value[0]] = Vocabulary(sent.value[1])
    return _LOADED[sent.value[0]]


def _sent(docs: DataFrame, vocabulary_path: str):
    """The vocabulary file is one file of fixed size, read by the driver and sent to the workers once."""
    with open(vocabulary_path, "rb") as file:
        content = file.read()
    return shared(docs.sparkSession, (hash(content), content))


def _lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(ids) // 4 for ids in encoded)])
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(encoded))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    Null and empty texts have an empty array. Repeated rows are encoded each. Marks of special tokens inside a text are
    encoded as those tokens. Further columns are left out.
    """
    sent = _sent(docs, vocabulary_path)

    def run(batches):
        vocabulary = _vocabulary(sent)
        for batch in batches:
            encoded = vocabulary.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(encoded)], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids and text: the bytes of the tokens in order, special tokens included; null ids give empty text."""
    sent = _sent(encoded, vocabulary_path)

    def run(batches):
        vocabulary = _vocabulary(sent)
        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.values.to_pylist(), column.offsets.to_pylist()
            texts = [vocabulary.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select(F.col("doc_id").cast("long"), F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))
    return map_batches(rows, run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids and text, decoded from the ids: `encode` and `decode` by one worker, which holds the vocabulary once."""
    sent = _sent(docs, vocabulary_path)

    def run(batches):
        vocabulary = _vocabulary(sent)
        for batch in batches:
            encoded = vocabulary.encode([t or "" for t in batch.column(1).to_pylist()])
            texts = [vocabulary.decode(np.frombuffer(ids, np.int32).tolist()) for ids in encoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(encoded), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and again decoded texts."""
    return round_trip(docs, vocabulary_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
