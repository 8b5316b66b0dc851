"""Cuts texts where byte-level BPE always cuts, so that each distinct piece need be encoded once."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the space; \\s of this module knows a few more than Unicode's property, which does no harm here.
_ODD = re.compile(r"[^\S ]")
_SPACE = re.compile(r"\s")


def divisible(text: str) -> bool:
    """Whether every space of a text begins a pre-token: not so where it stands between white space, or last after some."""
    return "  " not in text and not (_ODD.search(text) and re.search(r"\s (?:\s|$)", text))


class ChunkEncoder:
    """Encodes texts by way of `resolve`, which gets distinct chunks and returns the packed ids of each, of type `kind`.

    The pre-tokenizer takes one space into the token that follows it and never ends a token with a space that a character
    other than white space follows. So a text falls into its first word and then chunks of a space and a word, each encoded
    for itself as in the whole. Texts of which this isn't sure are one chunk, and so are those that hold one of the strings in
    `apart`, which the library cuts out before it looks for pre-tokens. The words of a batch are numbered, each
    distinct one is looked up once, and the ids are gathered by number. Chunks seen are kept up to `most`; beyond it the
    shortest `share` of so many stay, as long ones come back least, so that many batches pass until the next such sweep.
    """

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], kind: str = "<u4", most: int = 1_000_000, share: float = 0.75, apart: tuple[str, ...] = ()):
        self.resolve, self.kind, self.most, self.share, self.apart, self.cache = resolve, np.dtype(kind), most, share, apart, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles: its passes over the kept chunks would cost more than the rest
        try:
            whole = [i for i, t in enumerate(texts) if "  " in t or any(x in t for x in self.apart)]
            taken = set(whole)
            rest = [i for i in range(len(texts)) if i not in taken]
            words = self._split([texts[i] for i in rest])
            found = list(map(self.cache.get, words[0]))
            if _SPACE.search("".join([x[-1:] for x, v in zip(words[0], found) if v is None])):
                # the space after such a word may begin no pre-token: the texts are looked at one by one
                whole += [i for i in rest if not divisible(texts[i])]
                taken = set(whole)
                rest = [i for i in rest if i not in taken]
                words = self._split([texts[i] for i in rest])
                found = list(map(self.cache.get, words[0]))
            out = dict(zip(whole, self.resolve([texts[i] for i in whole]), strict=True))
            out |= dict(zip(rest, self._gathered(*words, found), strict=True))
            return [out[i] for i in range(len(texts))]
        finally:
            if collecting:
                gc.enable()

    @staticmethod
    def _split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, the number of each word of all texts, where each text's begin)."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), parts.offsets.to_numpy()

    def _gathered(self, words: list[str], at: np.ndarray, offsets: np.ndarray, found: list[bytes | None]) -> list[bytes]:
        n = len(offsets) - 1
        if not n:
            return []
        first = at[offsets[:-1]]
        heads, which = np.unique(first, return_inverse=True)
        at = at.copy()
        at[offsets[:-1]] = len(words) + which
        packed = self._filled(words, found) + self.resolve([words[i] for i in heads.tolist()])
        size = self.kind.itemsize
        lens = np.fromiter(map(len, packed), np.int64, len(packed)) // size
        ids = np.frombuffer(b"".join(packed), self.kind)
        each = lens[at]
        ends = np.cumsum(each)
        total = int(ends[-1])
        place = np.repeat((np.cumsum(lens) - lens)[at] - (ends - each), each)
        place += np.arange(total)
        raw = memoryview(ids[place].tobytes())
        cuts = (np.concatenate(([0], ends))[offsets - offsets[0]] * size).tolist()
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _filled(self, words: list[str], found: list[bytes | None]) -> list[bytes]:
        """found with what the cache lacks; it is resolved and kept."""
        new = [x for x, v in zip(words, found) if v is None]
        if not new:
            return found
        # a letter and one of these marks at the end are never one token: the word before it is a chunk too
        marked = [x for x in new if x[-1:] in (",", ".") and x[-2:-1].isalpha()]
        fresh = dict.fromkeys(new)
        for x in marked:
            del fresh[x]
        fresh |= dict.fromkeys([y for x in marked if (y := x[:-1]) not in self.cache])
        fresh = dict(zip(fresh, self.resolve([" " + x for x in fresh]), strict=True))
        if marked:
            mark = dict(zip(",.", self.resolve([",", "."]), strict=True))
            fresh.update([(x, (fresh.get(x[:-1]) or self.cache[x[:-1]]) + mark[x[-1]]) for x in marked])
        self.cache.update(fresh)
        for x in [x for x in new if x[-1:].isspace()]:  # to be seen again by the next batch that has it
            del self.cache[x]
        if len(self.cache) > self.most:
            self._sweep(int(self.most * self.share))
        return [fresh[x] if v is None else v for x, v in zip(words, found)]

    def _sweep(self, room: int) -> None:
        """Leaves the shortest chunks, as many as there is room for; of the length that doesn't wholly fit, the newest."""
        size = np.fromiter(map(len, self.cache), np.int64, len(self.cache))
        fit = int(np.searchsorted(np.cumsum(np.bincount(size)), room, "right"))
        stays = size < fit
        last = np.flatnonzero(size == fit)
        stays[last[len(last) - (room - int(stays.sum())) :]] = True
        self.cache = dict(compress(self.cache.items(), stays.tolist()))
