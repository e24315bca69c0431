"""Ids of whole texts by a public tokenizer, with what it has already encoded kept.

A text is cut at single spaces and line feeds into parts whose encodings do not
depend on each other. Parts repeat far more often than texts, so each is encoded
once while it stays in use and its ids are looked up after that. Texts go to the
tokenizer whole where cutting could differ: those with a special token of it, and
those with other white space beside a cut. The result is that of ``encode(text,
add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import cache

#: parts in each of the two generations of a Python worker's lookup, some 140 bytes each;
#: fewer cost time, as each part that is not known is encoded again
KEEP = 1_000_000
#: marks after a word, and how many of them at most are looked up apart; an apostrophe is none, it may bind letters
MARKS, LONGEST_TAIL = ".,;:!?*$&%#", 4
#: longer parts are encoded but not kept
LONGEST = 64


class Kept:
    """A lookup in two generations: what is not asked for while one fills up, goes."""

    def __init__(self, keep: int):
        self.keep = keep
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that are not known; all others are in ``new`` afterwards."""
        missing = keys.difference(self.new)
        if len(self.new) + len(missing) > self.keep:
            self.old, self.new, missing = self.new, {}, keys
        again = missing.intersection(self.old)
        self.new.update((x, self.old[x]) for x in again)
        return list(missing.difference(again))

    def learn(self, keys: list[str], values: list[bytes]) -> None:
        self.new.update(zip(keys, values, strict=True))

    def forget(self, keys: set[str]) -> None:
        """Drops what is long, once it has been used."""
        for x in keys:
            if len(x) > LONGEST:
                del self.new[x]


class Encoder:
    """Bytes of little-endian ids of texts, in unsigned numbers of array type ``kind``."""

    def __init__(self, path: str, kind: str, spaces: bool, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)).search if special else lambda text: None
        #: whether the space before a word belongs to it
        self.space = " " if spaces else ""
        self.parts = Kept(keep)
        self.tails: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        assert sys.byteorder == "little"
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.kind, x.ids).tobytes() for x in found]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        texts = [text or "" for text in texts]
        out: list[bytes | None] = [None] * len(texts)
        cut = {i: t.replace("\n", " \n").split(" ") for i, t in enumerate(texts) if not self.special(t)}
        found = self.parts.missing(set().union(*(x[1:] for x in cut.values())))
        missing = [x for x in found if (body := x[1:] if x[:1] == "\n" else x) and body.strip() == body]
        # with no white space at its edges but one line feed before it, a part is encoded alike beside any other;
        # letters and the marks after them are encoded apart, so a known word need not be encoded again
        joined = {}
        for x in missing:
            word = x.rstrip(MARKS)
            if len(word) < len(x) <= len(word) + LONGEST_TAIL and word.isalpha():
                joined[x] = (word, x[len(word) :])
        single = {x for x in missing if x not in joined} | {w for w, _ in joined.values() if w not in self.parts.new}
        tails = {t for _, t in joined.values()}.difference(self.tails)
        heads = {i: x[0] for i, x in cut.items() if x[0] and x[0].strip() == x[0]}
        ask = [x if x[0] == "\n" else self.space + x for x in single] + [*tails] + [*heads.values()]
        fresh = self._encode(ask)
        self.parts.learn([*single], fresh[: len(single)])
        self.tails.update(zip(tails, fresh[len(single) : len(single) + len(tails)], strict=True))
        self.parts.learn([*joined], [self.parts.new[w] + self.tails[t] for w, t in joined.values()])
        fresh = fresh[len(single) + len(tails) :]
        get = self.parts.new.__getitem__
        for i, head in zip(heads, fresh, strict=True):
            try:
                out[i] = head + b"".join(map(get, cut[i][1:]))
            except KeyError:  # a part that depends on its neighbours
                continue
        self.parts.forget({*single, *joined})
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@cache
def encoder(path: str, kind: str, spaces: bool, keep: int = KEEP) -> Encoder:
    """One per Python worker."""
    return Encoder(path, kind, spaces, keep)
