"""Encoding a corpus with a public byte-level BPE tokenizer.

The distinct words of a batch are walked as a trie in depth-first order. The state of a node is the last token of the encoding
of its prefix; it follows from the states on the path alone, because two neighbouring tokens belong to an encoding exactly
when merging them alone gives them back. So every prefix that words share is encoded once, and a word's ids are read off its
path from the end. No shuffle is needed: rows stay where they are.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.runtime import table

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level tokenizer splits a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered between batches.
REMEMBERED = 100_000


def _byte_letters() -> dict[str, int]:
    """The letter each byte is written as in the vocabulary file: itself where printable, else the next free from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieEncoder:
    """Byte-level BPE over a vocabulary whose ids above the single bytes are in the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = _byte_letters()
        raw = {t: bytes(letter[c] for c in t) for t in model["vocab"] if all(c in letter for c in t)}
        self.ids = {b: model["vocab"][t] for t, b in raw.items()}
        self.size = {i: len(b) for b, i in self.ids.items()}
        self.halves = {i: (i, i) for b, i in self.ids.items() if len(b) == 1}
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = (m.split(" ") if isinstance(m, str) else m)[:2]
            x, y = model["vocab"][a], model["vocab"][b]
            t = model["vocab"].get(a + b)
            if t is not None and t not in self.halves:
                self.halves[t] = (x, y)
                self.merged[x, y] = t
        # tokens that no merge makes (special ones) are never the encoding of ordinary text
        self.ids = {b: i for b, i in self.ids.items() if i in self.halves}
        ends: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 1:
                ends.setdefault(b[-2:], set()).add(len(b))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """True when the bytes of a and b, encoded together, give a and b. Walks down the halves that meet at the border: the
        pair holds unless some merge across it comes before both sides are complete."""
        key = (a, b)
        hit = self.follows.get(key)
        if hit is None:
            hit = self.follows[key] = self._holds(a, b)
            if len(self.follows) > 1_000_000:
                self.follows.clear()
        return hit

    def _holds(self, a: int, b: int) -> bool:
        bar = 1 << 60
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bar:
                return False
            # undo the later of the two merges next to the border
            a_half, b_half = self.halves[a][1], self.halves[b][0]
            if a > b and a_half != a or b_half == b and a_half != a:
                bar, a = a, a_half
            elif b_half != b:
                bar, b = b + 1, b_half
            else:
                return True

    def alone(self, t: int) -> bool:
        """True when the bytes of a token are encoded as that token."""
        hit = self.whole.get(t)
        if hit is None:
            a, b = self.halves[t]
            hit = self.whole[t] = a == b == t or self.alone(a) and self.alone(b) and self.may_follow_below(a, b, t)
        return hit

    def may_follow_below(self, a: int, b: int, t: int) -> bool:
        """As ``may_follow``, with only the merges before t."""
        saved = self.merged.pop((a, b))
        try:
            return self._holds(a, b)
        finally:
            self.merged[a, b] = saved

    def words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words: the trie in depth-first order is the sorted words with the path of the one before."""
        coded = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        ids, ends = self.ids, self.ends
        last: list[int] = [-1]
        out = {}
        before = b""
        for b, w in coded:
            n = min(len(b), len(before))
            d = 0
            while d < n and b[d] == before[d]:
                d += 1
            del last[d + 1 :]
            for depth in range(d + 1, len(b) + 1):
                found = -1
                for size in ends.get(b[max(0, depth - 2) : depth], ()) if depth > 1 else ():
                    if size > depth:
                        continue
                    t = ids.get(b[depth - size : depth])
                    if t is None:
                        continue
                    if self.alone(t) if size == depth else self.may_follow(last[depth - size], t):
                        found = t
                        break
                last.append(found if found >= 0 else ids[b[depth - 1 : depth]])
            path = []
            at = len(b)
            while at:
                path.append(last[at])
                at -= self.size[last[at]]
            out[w] = tuple(reversed(path))
            before = b
        return out

    def _pieces(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        pieces = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {w for ps in pieces for w in ps if w not in known}
        known.update(self.words(list(new)))
        return pieces

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; no list of ids is built."""
        pieces, known = self._pieces(texts), self.known
        size: dict[str, int] = {}
        out = []
        for ps in pieces:
            n = 0
            for w in ps:
                k = size.get(w)
                if k is None:
                    k = size[w] = len(known[w])
                n += k
            out.append(n)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        pieces, known = self._pieces(texts), self.known
        out = []
        for ps in pieces:
            ids: list[int] = []
            for w in ps:
                ids += known[w]
            out.append(ids)
        return out


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("KINETRAIL_TOKENIZERS", TOKENIZERS), f"{name}.json")


def slices(texts: list, most_chars: int = 2_000_000):
    """Index ranges of at most so many characters, one text at least."""
    a = n = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if i > a and n + size > most_chars:
            yield a, i
            a, n = i, 0
        n += size
    if a < len(texts):
        yield a, len(texts)


def encode_corpus(docs: DataFrame, path: str) -> DataFrame:
    """``docs``: doc_id, text. Returns doc_id and ids, one row for each row of ``docs``; null and empty texts give an empty list,
    blank ones are encoded as they are, strings that look like special tokens are plain text. Other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = enc.encode_batch(texts[a:b])
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(offsets, flat)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def p6_ids(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), vocabulary())
