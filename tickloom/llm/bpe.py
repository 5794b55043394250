"""Byte-level BPE encoding and decoding with a pair occurrence index.

A batch's distinct pre-tokens are laid out in one symbol array. The index maps each mergeable pair to all its
positions in that array; active ranks are taken in ascending order, one rank's merges are applied at all its
positions at once, and only the lists of the pairs that appear beside the new symbols are updated. Text never
leaves the row it is in: the operator is one map over the documents, without a shuffle.

Defined results: a null text counts as empty; an empty text has no token; a text of any length is taken in
slices of pre-tokens, so memory is bounded by the batch and not by the longest text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pre-token pattern of the byte-level vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens taken at once from one text, characters taken at once from one batch, distinct pre-tokens kept.
SLICE, CHARS, KEPT = 500_000, 4_000_000, 250_000
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder for one vocabulary file (`tokenizers` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        signs = byte_symbols()
        back = {c: b for b, c in enumerate(signs)}
        self.of_byte = np.array([vocab[c] for c in signs], np.int32)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        first = self.of_byte.astype(np.int64)
        self.byte_rank = self.rank((first[:, None] << 32 | first[None, :]).ravel()).reshape(256, 256)
        born = dict(zip(self.made.tolist(), range(len(merges)), strict=True))
        if any(max(born.get(a, -1), born.get(b, -1)) >= r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))):
            raise ValueError("a merge comes before the symbols that it joins")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.raw: list[bytes] = [b""] * size
        for word, i in vocab.items():
            if word not in self.added:
                self.raw[i] = bytes(back[c] for c in word)
        for word, i in self.added.items():
            self.raw[i] = word.encode()
        self.text_of = [str(i) for i in range(size)]
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[str, tuple[int, ...]] = {}

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_rank[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of ids of each word."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = len(data)
        sym = self.of_byte[data].astype(np.int64)
        ends = np.cumsum(sizes) - 1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.zeros(n, bool)
        last[ends[sizes > 0]] = True
        after[last] = -1
        before[1:][last[:-1]] = -1
        rank = np.full(n, NO_RANK)
        rank[:-1] = np.where(last[:-1], NO_RANK, self.byte_rank[data[:-1], data[1:]])
        index: dict[int, list[np.ndarray]] = {}  # the pair occurrence index: rank of a pair -> its positions

        def enter(at: np.ndarray, of: np.ndarray) -> None:
            use = of < NO_RANK
            at, of = at[use], of[use]
            if not len(at):
                return
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for r, part in zip(of[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        active: list[int] = []
        enter(np.arange(n), rank)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            pos = pos[sym[pos] == a]
            nxt = after[pos]
            good = (nxt >= 0) & (sym[nxt] == b)
            pos, nxt = pos[good], nxt[good]
            if a == b and len(pos) > 1:  # aaa: every other one, from the left
                chained = nxt[:-1] == pos[1:]
                start = np.maximum.accumulate(np.where(np.r_[True, ~chained], np.arange(len(pos)), 0))
                even = (np.arange(len(pos)) - start) % 2 == 0
                pos, nxt = pos[even], nxt[even]
            if not len(pos):
                continue
            new = int(self.made[r])
            sym[pos], sym[nxt] = new, -1
            then = after[nxt]
            after[pos] = then
            more = then >= 0
            before[then[more]] = pos[more]
            prior = before[pos]
            some = prior >= 0
            at = np.concatenate((prior[some], pos[more]))
            enter(at, self.rank(np.concatenate((sym[prior[some]] << 32 | new, new << 32 | sym[then[more]]))))
        live = sym >= 0
        return sym[live].astype(np.int32), np.add.reduceat(np.r_[live, False], ends - sizes + 1).astype(np.int64) * (sizes > 0) if len(words) else sizes

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the distinct pre-tokens that are not known yet."""
        new = [p for p in set(pieces) if p not in self.known]
        if not new:
            return
        ids, sizes = self.merge([p.encode() for p in new])
        ids, at = ids.tolist(), 0
        for p, k in zip(new, sizes.tolist(), strict=True):
            self.known[p] = tuple(ids[at : at + k])
            at += k

    def slices(self, text: str) -> Iterator[list[str] | int]:
        """A text as lists of pre-tokens, with the ids of added tokens between them."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield from self.plain(text[at : m.start()])
            yield self.added[m.group()]
            at = m.end()
        yield from self.plain(text[at:] if at else text)

    def plain(self, text: str) -> Iterator[list[str]]:
        if len(text) <= SLICE:
            yield self.words.findall(text)
            return
        found = (m.group() for m in self.words.finditer(text))
        while part := list(islice(found, SLICE)):
            yield part

    def ids(self, part: list[str] | int) -> list[int]:
        return [part] if isinstance(part, int) else list(chain.from_iterable(map(self.known.__getitem__, part)))

    def encode_batch(self, texts: Iterable[str]) -> Iterator[Iterator[list[int]]]:
        """For each text, its ids in slices. Texts are taken in groups, so that their pre-tokens are merged together."""
        group, chars = [], 0
        for text in texts:
            if len(text) > CHARS:  # on its own, slice by slice
                yield from self.group(group)
                group, chars = [], 0
                yield self.long(text)
                continue
            group.append(text)
            chars += len(text)
            if chars > CHARS:
                yield from self.group(group)
                group, chars = [], 0
        yield from self.group(group)

    def group(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        parts = [list(self.slices(t)) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        self.learn(chain.from_iterable(p for doc in parts for p in doc if not isinstance(p, int)))
        for doc in parts:
            yield map(self.ids, doc)

    def long(self, text: str) -> Iterator[list[int]]:
        for part in self.slices(text):
            if len(self.known) > KEPT:
                self.known.clear()
            self.learn(() if isinstance(part, int) else part)
            yield self.ids(part)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PairIndexBPE:
    """One codec for each worker process and vocabulary file."""
    return PairIndexBPE(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and the token ids of each text (array of int, in order)."""

    def run(batches):
        bpe = codec(path)
        for pdf in batches:
            out = [list(chain.from_iterable(parts)) for parts in bpe.encode_batch(x if isinstance(x, str) else "" for x in pdf["_text"])]
            yield pd.DataFrame({key: pdf[key], "ids": out})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("_text")).mapInPandas(run, f"{key} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """`key` and the text that the ids stand for; broken UTF-8 becomes the replacement character."""

    def run(batches):
        bpe = codec(path)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": ["" if x is None else bpe.decode(x) for x in pdf["ids"]]})

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInPandas(run, f"{key} {kind}, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the number of ids, the digest of the ids and the digest of the text decoded from them.

    The ids of a text are encoded, written out and decoded slice by slice, so that none is held whole.
    """

    def run(batches):
        bpe = codec(path)
        for pdf in batches:
            rows = []
            for parts in bpe.encode_batch(x if isinstance(x, str) else "" for x in pdf["_text"]):
                n, ids_hash, text_hash, rest = 0, hashlib.sha256(), hashlib.sha256(), b""
                for ids in parts:
                    if not ids:
                        continue
                    if n:
                        ids_hash.update(b",")
                    n += len(ids)
                    ids_hash.update(",".join(map(bpe.text_of.__getitem__, ids)).encode())
                    raw = rest + bpe.decode_bytes(ids)
                    whole = len(raw) - next((k for k in range(1, min(4, len(raw) + 1)) if raw[-k] >= 0xC0), 0)
                    rest = raw[whole:]  # a character may go on in the next slice
                    text_hash.update(raw[:whole].decode("utf-8", "replace").encode())
                text_hash.update(rest.decode("utf-8", "replace").encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("_text")).mapInPandas(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
