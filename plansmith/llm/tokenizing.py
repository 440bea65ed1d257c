"""Fast ids of whole texts with the tokenizers library: every distinct chunk is encoded once per worker.

A chunk is what lies between places where no token of the given vocabulary can reach across, so the ids of a text
are the ids of its chunks in a row. The cache is bounded; long chunks bypass it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

from plansmith.llm.workers import forgets

CACHED_CHUNKS = 1_000_000
CACHED_CHARS = 64
#: Characters of the texts whose new chunks are encoded together.
TOGETHER = 1 << 20
_READY: dict[str, "ChunkEncoder"] = {}

#: White space other than space, line feed, tab and carriage return: a text with leading-space chunks that holds any goes to the library whole.
_ODD_SPACES = [chr(c) for c in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEAD = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")


#: Visible ASCII and the letters of Latin-1: composed already, and their lower case stays among them.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
LATIN_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Byte-level spelling of the first 256 characters.
BYTES = {c: "".join(_HIDDEN.get(b, chr(b)) for b in chr(c).encode()) for c in range(256)}


def _way(spec: dict) -> str:
    """drop: white space never enters a token; lead: a space may start one (byte-level pattern); whole: don't know."""
    norm, pre = json.dumps(spec.get("normalizer")), spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None:
        return "lead"
    steps = pre.get("pretokenizers", [])
    if '"Lowercase"' in norm and '"\\\\s+"' in norm and steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        return "drop"
    return "whole"


def _odd(text: str) -> bool:
    return any(c in text for c in (_ODD_SPACES[:6] if text.isascii() else _ODD_SPACES))


class Chunked:
    """ids of texts from a cache of chunks. Subclasses set way and define fresh(chunks).

    Where spaces lead, a chunk is named without its space, and one that has none with a space: most names are then the
    parts that str.split() gives.
    """

    way = "whole"

    def __init__(self) -> None:
        self.cache: dict[str, bytes] = {}

    def fresh(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def spelled(self, name: str) -> str:
        return name if self.way != "lead" else name[1:] if name[:1] == " " else " " + name

    def _cut(self, text: str) -> list[str]:
        if self.way == "drop":
            return text.replace("\n", " ").replace("\t", " ").split(" ")
        if self.way == "lead":
            if _odd(text):
                return [" " + text]
            if any(pair in text for pair in ("  ", "\n ", "\t ", "\r ")):
                return [c[1:] if c[0] == " " and c[1:2] != " " else " " + c for c in _LEAD.findall(text)]
            chunks = text.split(" ")
            chunks[0] = " " + chunks[0]
            return chunks if len(chunks[0]) > 1 else chunks[1:]
        return [text]

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """ids of each text (null: empty) as little-endian uint32 bytes; new chunks of some texts at a time are encoded together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self._cut(text or ""))
            size += len(text or "") + 256
            if size > TOGETHER:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, texts: list[list[str]]) -> Iterator[bytes]:
        cache = self.cache
        found = [list(map(cache.get, chunks)) for chunks in texts]
        gaps = [[i for i, x in enumerate(parts) if x is None] if None in parts else [] for parts in found]
        new = list({chunks[i] for chunks, at in zip(texts, gaps, strict=True) for i in at})
        got = dict(zip(new, self.fresh(new), strict=True))
        for chunks, parts, at in zip(texts, found, gaps, strict=True):
            for i in at:
                parts[i] = got[chunks[i]]
            yield b"".join(parts)
        if len(cache) + len(got) > CACHED_CHUNKS:
            cache.clear()
        cache.update((c, x) for c, x in got.items() if len(c) <= CACHED_CHARS)

    def ids(self, text: str | None) -> bytes:
        return next(self.many([text]))


class ChunkEncoder(Chunked):
    """ids(text) equals encode(text, add_special_tokens=False).ids without truncation or padding."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.way = _way(json.load(open(path, encoding="utf-8")))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.tails: dict[str, bytes] = {}

    def fresh(self, chunks: list[str]) -> list[bytes]:
        """A tail of punctuation behind a letter or digit is a token run of its own."""
        if self.way == "whole":
            return [self._library(c) for c in chunks]
        return [self._split(c) for c in chunks]

    def _split(self, name: str) -> bytes:
        head = name.rstrip(",.!|")
        if len(head) != len(name) and head and head[-1].isalnum() and head[-1] < "\u0250":
            tail = name[len(head) :]
            if tail not in self.tails:
                self.tails[tail] = self._library(tail)
            return self._known(head) + self.tails[tail]
        return self._known(name)

    def _known(self, name: str) -> bytes:
        ids = self.cache.get(name)
        if ids is None:
            ids = (self._lead if self.way == "lead" else self._drop)(name)
            if len(name) <= CACHED_CHARS:
                self.cache[name] = ids
        return ids

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _letters(self, spelling: str) -> bytes:
        """A run of letters is one token run: the library's model takes it without normaliser and pattern."""
        return array("I", [t.id for t in self.model.tokenize(spelling)]).tobytes()

    def _drop(self, name: str) -> bytes:
        if name.isascii() and name.isalpha() or LATIN_LETTERS.fullmatch(name):
            low = name.lower()
            return self._known(low) if low != name else self._letters(name if name.isascii() else name.translate(BYTES))
        return self._library(name)

    def _lead(self, name: str) -> bytes:
        if name.isascii() and name.isalpha():
            return self._letters(BYTES[32] + name)
        text = self.spelled(name)
        if LATIN_LETTERS.fullmatch(text, 1 if text[:1] == " " else 0):
            return self._letters(text.translate(BYTES))
        if "\n" in text and not _odd(text):
            parts = _LEAD.findall(text)
            if len(parts) > 1:
                return b"".join([self._split(p[1:] if p[0] == " " and p[1:2] != " " else " " + p) for p in parts])
            if text[1:2].isalnum():  # one line feed, which no token of letters or digits takes in
                return self._known(" \n") + self._split(" " + text[1:])
        return self._library(text)


def _forget() -> None:
    for known in _READY.values():
        known.cache.clear()


forgets(_forget)


def encoder(path: str) -> ChunkEncoder:
    if path not in _READY:
        _READY[path] = ChunkEncoder(path)
    return _READY[path]


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies keep a file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
