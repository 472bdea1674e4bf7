"""Byte-pair merging by the ranks of a public tokenizer file."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = [""] * 256
    for byte in shown:
        letters[byte] = chr(byte)
    spare = 0x100
    for byte in range(256):
        if not letters[byte]:
            letters[byte] = chr(spare)
            spare += 1
    return letters


LETTERS = byte_alphabet()
# Words of more symbols are merged with a heap.
LONG = 100
NEVER = 1 << 60
BYTES = {letter: byte for byte, letter in enumerate(LETTERS)}


class MergeModel:
    """Vocabulary and merge ranks; ``end`` marks the last symbol of a word, if used."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str, special: dict[str, int]):
        self.vocab = vocab
        self.end = end
        self.special = special
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.ranks = {(left, right): rank for rank, (left, right) in enumerate(pairs)}

    @staticmethod
    @lru_cache(1)
    def load(path: str) -> MergeModel:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        return MergeModel(model["vocab"], model["merges"], model["end_of_word_suffix"] or "", special)

    def symbols(self, word: bytes) -> list[str]:
        parts = [LETTERS[b] for b in word]
        parts[-1] += self.end
        return parts

    def merge(self, parts: list[str]) -> list[str]:
        """Join the pair of lowest rank, the leftmost of equals, until none is left."""
        if len(parts) > LONG:
            return self._merge_long(parts)
        parts, get = list(parts), self.ranks.get
        ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap, as every step of ``merge`` passes over the whole word."""
        count = len(parts)
        parts, ranks = list(parts), self.ranks
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        after[-1] = -1
        heap = []
        for i in range(count - 1):
            rank = ranks.get((parts[i], parts[i + 1]))
            if rank is not None:
                heap.append((rank, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                rank = ranks.get((parts[i], parts[after[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))
            if before[i] >= 0:
                rank = ranks.get((parts[before[i]], parts[i]))
                if rank is not None:
                    heapq.heappush(heap, (rank, before[i], parts[before[i]], parts[i]))
        return [part for part in parts if part]

    def split(self, token: str) -> list[str]:
        """The symbols of a token of the vocabulary."""
        body = token.removesuffix(self.end) if self.end and token != self.end else token
        parts = list(body)
        if body != token:
            parts[-1] += self.end
        return parts

    def halves(self, token: str) -> tuple[str, str] | None:
        """The pair whose merge completes a token that merging can make; None for a single symbol."""
        parts = self.split(token)
        if len(parts) == 1:
            return None
        rank = {(a, b): r for (a, b), r in self._within(parts).items() if a + b == token}
        return min(rank, key=rank.get)

    def _within(self, parts: list[str]) -> dict[tuple[str, str], int]:
        """Pairs of a token's prefixes and suffixes that merging makes on their own."""
        found = {}
        for cut in range(1, len(parts)):
            pair = "".join(parts[:cut]), "".join(parts[cut:])
            if pair in self.ranks and self.merge(parts[:cut]) == [pair[0]] and self.merge(parts[cut:]) == [pair[1]]:
                found[pair] = self.ranks[pair]
        return found

    def ids(self, word: bytes) -> list[int]:
        return [self.vocab[part] for part in self.merge(self.symbols(word))]

    def token_bytes(self) -> dict[int, bytes]:
        """What each id stands for; special tokens stand for their own text."""
        found = {i: token.encode() for token, i in self.special.items()}
        for token, i in self.vocab.items():
            found.setdefault(i, bytes(BYTES[c] for c in token) if all(c in BYTES for c in token) else token.encode())
        return found
