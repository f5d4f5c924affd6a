"""Byte-level vocabularies: reading the file, cutting texts into words, exact merging of one word."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

#: Fixed value: the word pattern of the byte-level vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ANY = regex.compile(PATTERN)
# For texts of Latin letters the standard library's classes agree with the pattern's and are faster.
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[\x1c-\x1f²³¹¼-¾]|[^\x00-ɏ]")


def words_of(text: str) -> list[str]:
    return (_ANY if _OTHER.search(text) else _LATIN).findall(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next letter from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """pieces: the bytes of each id. ranks: (left id, right id) -> merged id; a lower id merges first."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, model = byte_letters(), data["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in self.special}
        self.ranks: dict[tuple[int, int], int] = {}
        last = -1
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            new = ids[a + b]
            if new <= last:
                raise ValueError("the merges are not in the order of the ids")
            self.ranks[ids[a], ids[b]] = last = new
        self.byte_id = [0] * 256
        for i, piece in self.pieces.items():
            if len(piece) == 1:
                self.byte_id[piece[0]] = i
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for content, i in self.special.items():
            self.pieces[i] = content.encode()

    def segments(self, text: str) -> list[str]:
        """Ordinary texts at even places, special tokens at odd ones."""
        return self.split.split(text) if self.split and any(x in text for x in self.special) else [text]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank merges first, the leftmost of equals."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        ranks = self.ranks
        pairs = [ranks.get(p, 1 << 30) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == 1 << 30:
                break
            k = pairs.index(best)
            ids[k : k + 2] = [best]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get((best, ids[k + 1]), 1 << 30)
            if k:
                pairs[k - 1] = ranks.get((ids[k - 1], best), 1 << 30)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = rank, False, after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get((rank, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, rank, ids[after[k]]))
            if before[k] >= 0 and (r := ranks.get((ids[before[k]], rank))) is not None:
                heapq.heappush(heap, (r, before[k], ids[before[k]], rank))
        return [x for x, y in zip(ids, alive) if y]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
