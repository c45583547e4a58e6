"""Token ids of public vocabularies, through a memo of words that is bounded by its bytes.

A worker holds the vocabulary itself (some 120 MB with its libraries) and at most MEMO_BYTES for each memo; no text is read in stretches of more than
STRETCH characters or words at once, so that what a worker needs doesn't grow with its texts or with the number of different words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

MEMO_BYTES = 128 << 20
#: What a kept word takes besides its characters.
ENTRY_BYTES = 240
STRETCH = 1 << 15
#: White space before a space, or two spaces: words of such texts don't stand alone.
_TIED = re.compile(r"\s |<\|")
#: Words whose classes (letter, digit, white space) are the same in every Unicode version.
_LATIN = re.compile(r"[\x00-ɏ]*[^\s]")


class Memo:
    """What is known of words, within about ``limit`` bytes. A full memo is given up for an empty one, which soon holds the frequent words again."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.held = limit, 0
        self.known: dict[str, object] = {}

    def add(self, words: list[str], values: Iterable) -> dict:
        """The values by word, which are kept, too."""
        found = dict(zip(words, values))
        size = ENTRY_BYTES * len(found) + 2 * sum(map(len, found))
        if self.held + size > self.limit:  # a new dictionary, as the old one may be in use
            self.known, self.held = {}, 0
        if size <= self.limit:
            self.known |= found
            self.held += size
        return found


#: Where a text may be cut without changing its ids: before a single space between visible characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Parts of a text of size characters or a little more, the last one shorter; all but the first begin with a space."""
    at = 0
    while len(text) - at > size and (found := _CUT.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class ByteBPE:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    Its pre-tokenizer never joins a word to what stands before the word's own space, unless that is white space, too.
    Where each space follows a visible character, a text is therefore cut at its spaces and its words are looked up.
    New words of Latin characters are merged in one go by tiktoken from the same vocabulary file, which gives the same
    ids several times faster; everything else goes to the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if len(word) == 1 or word in merged}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merger = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.sizes[i] = len(word)
        #: By word: at a text's start, and after a space (which belongs to the word).
        self.first, self.after = Memo(MEMO_BYTES // 16), Memo()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of words that each follow a space and end in a visible character, merged as one text."""
        ids = np.array(self.merger.encode_ordinary(" " + " ".join(words)), np.uint32)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that follow a space."""
        simple = [w for w in words if _LATIN.fullmatch(w)]
        found = self.after.add(simple, self._merge(simple)) if simple else {}
        other = [w for w in words if w not in found]
        return found | self.after.add(other, self._library([" " + w for w in other])) if other else found

    def _start(self, word: str) -> bytes:
        known = self.first.known.get(word)
        return self.first.add([word], self._library([word]))[word] if known is None else known

    def _rest(self, words: list[str]) -> bytes:
        known = self.after.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            new = self._learn([*set(words).difference(known)])
            return b"".join([known[w] if w in known else new[w] for w in words])

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if _TIED.search(text):
            return b"".join([self._library([part])[0] for part in stretches(text)])
        start, *words = text.split(" ")
        rest = b"".join([self._rest(words[at : at + STRETCH]) for at in range(0, len(words), STRETCH)])
        return self._start(start) + rest if start else rest


@cache
def byte_bpe(path: str) -> ByteBPE:
    """One for each worker process and file."""
    return ByteBPE(path)
