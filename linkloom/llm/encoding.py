"""Token ids of whole texts by a public tokenizer, with a cache of what stands between white space.

Both public pre-tokenizers in use never join characters across the start of a run
of white space, so a text's ids are those of its pieces one after another. Pieces
repeat, so what was encoded is kept for a while, and so are their words: the
pieces that have not come before are mostly words with other punctuation. Texts for which that is not certain (special
tokens' strings, separators that libraries class differently) and tokenizers of
other kinds are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

#: Entries of both halves of the cache, some 200 MB.
CACHE_ENTRIES = 700_000
#: Longer pieces are not kept.
CACHED_CHARS = 48
#: Ids as bytes, by their number; characters that are kept have three bytes at most.
PACKED = [struct.Struct(f"<{n}I").pack for n in range(3 * CACHED_CHARS + 1)]
#: Characters of spans whose pieces are counted together.
GROUP_CHARS = 2_000_000
#: Pieces that are counted in one call, and runs of other characters beside words that are kept.
JOINED = 2_000
#: Pieces whose counts a half of a counter's cache holds, their characters together, and the characters of one; some 65 MB.
COUNTED_PIECES, COUNTED_CHARS, COUNTED_PIECE_CHARS = 600_000, 16_000_000, 100_000
#: Characters that Python and the tokenizers library may not both take for white space.
DOUBTFUL = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
RUNS = re.compile(r"\s*\S+|\s+")
#: A word of Latin letters and the ASCII punctuation after it, between which the byte-level pre-tokenizer always cuts, and nowhere else.
LATIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af]+)([!-/:-@\[-`{-~]*)")
#: The same as a piece, with the line's end before it.
LATIN_PIECE = re.compile(rf"(\n?){LATIN.pattern}")
#: White space of two characters, which is cut between them if a word follows, and longer runs or those at a text's end, which may not be.
PAIRS, LONG_RUN = ("  ", "\n\n", " \n", "\n "), re.compile(r"\s\s(?:\s|\Z)")
#: The pattern by which a tokenizer that drops white space cuts words; letters and punctuation stand apart in it as well.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: The characters by which byte-level tokenizers show bytes.
BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _shown)}
SPACE = chr(BYTE_CHARS[0x20])
#: The same for the characters of ``LATIN``, as they are and lowered.
SHOWN, LOWERED = ({c: how(chr(c)).encode().decode("latin-1").translate(BYTE_CHARS) for c in range(0x20, 0x2B0)} for how in (str, str.lower))


def grouped(items: Iterable, size: Callable, most: int = GROUP_CHARS) -> Iterator[list]:
    """Lists of items one after another; each ends once its sizes sum to ``most`` or more."""
    group, held = [], 0
    for item in items:
        group.append(item)
        held += size(item)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


_encoders: dict[tuple[str, int], Encoder] = {}
_counters: dict[str, Counter] = {}


def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """The process's encoder for a tokenizer: tasks of one worker share its cache."""
    if (path, entries) not in _encoders:
        _encoders[path, entries] = Encoder(path, entries)
    return _encoders[path, entries]


def forget() -> None:
    """Drops the process's encoders and counters."""
    _encoders.clear()
    _counters.clear()


def _keeps_words(spec: dict) -> bool:
    """Whether the model alone gives a Latin word's ids: the word is cut from what stands beside it, and its letters are at most lowered."""
    model, pre, norm = spec["model"], spec["pre_tokenizer"], spec.get("normalizer") or {}
    if model.get("type") != "BPE" or model.get("dropout"):
        return False
    if pre["type"] == "ByteLevel":
        return not norm
    cut, shown = pre["pretokenizers"]
    steps = [(n["type"], n.get("pattern")) for n in norm.get("normalizers", [])]
    lowered = steps == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
    return lowered and cut["pattern"] == {"Regex": WORD_SPLIT} and not (shown.get("add_prefix_space") or shown.get("use_regex"))


class Encoder:
    """``ids(texts)`` yields each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        drops = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") for p in parts)
        if drops and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
            self.pieces = str.split
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.pieces = RUNS.findall
        else:
            self.pieces = None
        special = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []))
        self.whole = re.compile(f"[{DOUBTFUL}]" + (f"|{special}" if special else ""))
        self.ascii_doubts = ["\x1c", "\x1d", "\x1e", "\x1f", *(t["content"] for t in spec.get("added_tokens", []))]
        self.model = self.tokenizer.model if self.pieces and _keeps_words(spec) else None
        self.lowers = self.pieces is str.split
        self.known = Known(self, entries)

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """The ids of a word of Latin letters, by the model alone."""
        if not word.isascii():
            shown = word.translate(LOWERED if self.lowers else SHOWN)
        else:
            shown = word.lower() if self.lowers else word.replace(" ", SPACE)
        ids = [t.id for t in self.model.tokenize(shown)]
        return PACKED[len(ids)](*ids)

    def _is_doubtful(self, text: str) -> bool:
        if text.isascii():
            return any(c in text for c in self.ascii_doubts)
        return self.whole.search(text) is not None

    def _split(self, text: str) -> list[str]:
        """The pieces; of a text that is not doubtful, so ``\x1c`` is free to mark where they begin."""
        if self.pieces is str.split or any(c in text for c in "\t\r\x0b\x0c") or (any(c in text for c in PAIRS) and LONG_RUN.search(text)):
            return self.pieces(text)
        found = text.replace(" ", "\x1c ").replace("\n", "\x1c\n").split("\x1c")
        return found if found[0] else found[1:]

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Null counts as empty."""
        for text in texts:
            text = text or ""
            if self.pieces is None or self._is_doubtful(text):
                yield self._encoded(text)
            else:
                yield b"".join(map(self.known.__getitem__, self._split(text)))


class Known(dict):
    """The ids of pieces: what is missing is encoded when it is asked for.

    It stays in two halves: when the newer one, this dictionary, is full it takes the
    place of the older one. So what a text costs does not depend on how many were
    encoded before it. Of a word with other characters about it the word is kept,
    and all of it only once the word has come before.
    """

    def __init__(self, codec: Encoder, entries: int):
        self.codec, self.half = codec, entries // 2
        self.older: dict[str, bytes] = {}
        self.others = {"": b""}

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _other(self, chars: str) -> bytes:
        if (ids := self.others.get(chars)) is None:
            if len(self.others) >= JOINED:
                self.others = {"": b""}
            ids = self.others[chars] = self.codec._encoded(chars)
        return ids

    def __missing__(self, piece: str) -> bytes:
        codec = self.codec
        if (ids := self.older.get(piece)) is not None:
            return self._keep(piece, ids)
        if len(piece) > CACHED_CHARS:
            return codec._encoded(piece)
        if codec.model is None:
            return self._keep(piece, codec._encoded(piece))
        if piece.isascii() and (piece[1:] if piece[0] == " " else piece).isalpha():
            return self._keep(piece, codec._word(piece))
        if not (m := LATIN_PIECE.fullmatch(piece)) or (codec.lowers and "\u0130" in piece):
            return self._keep(piece, codec._encoded(piece))
        before, word, after = m.groups()
        if word == piece:
            return self._keep(piece, codec._word(piece))
        ids = self.get(word)
        if ids is not None or (ids := self.older.get(word)) is not None:
            return self._keep(piece, self._other(before) + ids + self._other(after))
        return self._other(before) + self._keep(word, codec._word(word)) + self._other(after)


class Counter:
    """``counter(spans)``: how many ids each span has, as many as ``Encoder`` gives.

    What was counted stays in two halves: when the newer one is full it takes the
    place of the older one. So a piece is encoded again only after many others, and
    what a text costs does not depend on how many were counted before it.
    """

    def __init__(self, path: str, pieces: int = COUNTED_PIECES, chars: int = COUNTED_CHARS):
        self.codec, self.pieces, self.chars = encoder(path), pieces, chars
        self.newer: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.held = 0
        self.model = self.codec.tokenizer.model if self.codec.pieces == RUNS.findall and self.codec.tokenizer.normalizer is None else None
        self.tails = {"": 0}

    def _encoded(self, pieces: list[str]) -> dict[str, int]:
        """Most pieces are single words: the model alone counts them, the others pass the whole tokenizer."""
        made, others, tokenize = {}, [], self.model and self.model.tokenize
        for p in pieces:
            if tokenize and (m := LATIN.fullmatch(p)):
                word, tail = m.groups()
                if tail not in self.tails:
                    if len(self.tails) >= JOINED:
                        self.tails = {"": 0}
                    self.tails[tail] = len(tokenize(tail))
                made[p] = len(tokenize(word.encode().decode("latin-1").translate(BYTE_CHARS))) + self.tails[tail]
            else:
                others.append(p)
        made.update(zip(others, map(len, self.codec.tokenizer.encode_batch_fast(others, add_special_tokens=False)), strict=True))
        return made

    def _learned(self, pieces: set[str]) -> dict[str, int]:
        """The counts of pieces that the newer half does not hold."""
        made = {p: n for p in pieces if (n := self.older.get(p)) is not None}
        new = [p for p in pieces if p not in made]
        for group in grouped(new, lambda p: max(len(p), GROUP_CHARS // JOINED)):
            made |= self._encoded(group)
        kept = {p: n for p, n in made.items() if len(p) <= COUNTED_PIECE_CHARS}
        self.newer |= kept
        self.held += sum(map(len, kept))
        if len(self.newer) >= self.pieces or self.held >= self.chars:
            self.older, self.newer, self.held = self.newer, {}, 0
        return made

    def _group(self, spans: list[str]) -> list[int]:
        codec, flat, ends = self.codec, [], [0]
        for s in spans:
            if codec.pieces is None or codec._is_doubtful(s):
                flat.append(s)
            else:
                flat += codec.pieces(s)
            ends.append(len(flat))
        found = list(map(self.newer.get, flat))
        holes = [k for k, n in enumerate(found) if n is None]
        made = self._learned({flat[k] for k in holes})
        for k in holes:
            found[k] = made[flat[k]]
        return [sum(found[b:e]) for b, e in pairwise(ends)]

    def __call__(self, spans: Iterable[str]) -> list[int]:
        return [n for group in grouped(spans, len) for n in self._group(group)]


def counter(path: str) -> Counter:
    """The process's counter for a tokenizer."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]
