"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of all new words of a batch. A proposal is right exactly if each token and
each adjacent pair of tokens is compatible: if merging their bytes alone gives them back. Pairs are checked for the
whole batch at once against a table that grows with the pairs met; only words with a pair that fails are merged exactly.
Vocabulary files are read where the given path says, once per Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
KEPT = 200_000  #: words remembered in each of two generations
SLICE = 1 << 21  #: characters of text whose new words are encoded together


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(letter[c] for c in token)
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.longest = max(map(len, self.id_of))
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge_of[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.alone: dict[int, bool] = {}
        self.pairs = np.empty(0, np.uint64)  # sorted: left << 32 | right
        self.fits = np.empty(0, bool)
        self.merged_words = self.new_words = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, least rank first, leftmost of equal ones: a heap of pairs over linked tokens, n log n."""
        ids: list[int | None] = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        if len(ids) < 2:
            return ids
        merge_of, n = self.merge_of, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # a neighbour has been merged meanwhile
            ids[i], ids[j] = made, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge_of.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, ids[k]))
            if (h := before[i]) >= 0 and (m := merge_of.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], made))
        return [x for x in ids if x is not None]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        found, at, id_of = [], 0, self.id_of
        n = len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (token := id_of.get(word[at:end])) is None:
                end -= 1
            found.append(token)
            at = end
        return found

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of tokens, whether exact merging of its bytes gives it back."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        new = np.setdiff1d(key, self.pairs)
        if len(new):
            fit = [self.merge(self.bytes_of[k >> 32] + self.bytes_of[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF] for k in new.tolist()]
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, fit)
        return self.fits[np.searchsorted(self.pairs, key)]

    def whole(self, token: int) -> bool:
        """Whether exact merging of a token's bytes gives the token."""
        if token not in self.alone:
            self.alone[token] = self.merge(self.bytes_of[token]) == [token]
        return self.alone[token]

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(r) for r in raw]
        counts = np.array([len(p) for p in proposed], np.int64)
        flat = np.array([t for p in proposed for t in p], np.int64)
        word = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(word[1:] == word[:-1])
        wrong = np.zeros(len(words), bool)
        if len(inner):
            wrong[word[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        unsound = {t for t in np.unique(flat).tolist() if not self.whole(t)}
        if unsound:
            wrong[word[np.isin(flat, list(unsound))]] = True
        packed = flat.astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        begin = 0
        for i, (w, end) in enumerate(zip(words, ends, strict=True)):
            self.young[w] = np.array(self.merge(raw[i]), "<u4").tobytes() if wrong[i] else packed[begin:end]
            begin = end
        self.new_words += len(words)
        self.merged_words += int(wrong.sum())

    def parts(self, text: str) -> list[list[str] | bytes]:
        """Words of the text's segments, and the special tokens between them already encoded."""
        if self.split is None or not any(s in text for s in self.special):
            return [self.words(text)]
        return [np.array([self.special[s]], "<u4").tobytes() if s in self.special else self.words(s) for s in self.split.split(text) if s]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            many, size = [], 0
            while at < len(texts) and (not many or size < SLICE):
                many.append(self.parts(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.young) > KEPT:
                self.old, self.young = self.young, {}
            met = set().union(*(p for parts in many for p in parts if isinstance(p, list))) - self.young.keys()
            for w in met & self.old.keys():
                self.young[w] = self.old[w]
            self.learn(list(met - self.old.keys()))
            get = self.young.__getitem__
            for parts in many:
                yield b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids themselves.

    A null text counts as empty and has no tokens. Repeated rows are encoded each; an empty table gives an empty
    result; other columns are ignored. Texts of any length are encoded whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for packed in c.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(packed) // 4)
                ids_sha.append(sha(packed))
                text_sha.append(sha(c.decode(packed).encode()))
                if with_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int64))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows: doc_id, ids (a list of token ids). (doc_id, text); null ids give an empty text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
