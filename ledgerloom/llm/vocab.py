"""Public BPE vocabularies (JSON of the tokenizers library) and their exact pre-tokenisation."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

# Pre-token patterns of the two vocabularies; \p{White_Space} is what their library takes for \s.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

NONE = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special strings of a vocabulary file; word ends carry a suffix if the file has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens: list[str] = [""] * size
        for table in (self.ids, self.special):
            for token, i in table.items():
                self.tokens[i] = token
        self.lower = spec.get("normalizer") is not None
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        self.quick = _quick_words() if self.lower else None
        chars = byte_chars()
        self.byte_ids = np.array([self.ids[c] for c in chars], np.int64)
        self.end_ids = np.array([self.ids[c + self.suffix] for c in chars], np.int64) if self.suffix else self.byte_ids
        left, right, made = (np.empty(len(model["merges"]), np.int64) for _ in range(3))
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left[k], right[k], made[k] = self.ids[a], self.ids[b], self.ids[a + b]
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.size, self._keys, self._ranks, self.made = size, key[order], order, made
        self.pairs = dict(zip(key.tolist(), range(len(key)), strict=True))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE where the pair is no merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NONE)

    def _normal(self, text: str) -> str:
        if not self.lower:
            return text
        try:  # up to U+00FF every letter is composed and has one lower-case form
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _normalizer().normalize_str(text)
        return text.lower()

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings stand alone."""
        if not any(map(text.__contains__, self.special)):
            return self._split(self._normal(text))
        out: list[str] = []
        for k, part in enumerate(self._split_special.split(text)):
            out += [part] if k % 2 else self._split(self._normal(part))
        return out

    def _split(self, text: str) -> list[str]:
        odd = None if text.isascii() else odd_characters(text)
        if not odd:
            plain = self.quick and (text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text))
            return (self.quick if plain else self.pattern).findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(odd))]

    def symbols(self, word: str) -> np.ndarray:
        """Ids of the single bytes of a pre-token, the last with the word-end suffix."""
        raw = np.frombuffer(word.encode(), np.uint8)
        ids = self.byte_ids[raw]
        if len(raw):
            ids[-1] = self.end_ids[raw[-1]]
        return ids


#: Characters whose class has been looked up; and those that the library puts into another class than the regex module (their tables follow different versions of Unicode), each with a character of its class that both agree on.
_seen: set[str] = set()
_odd: dict[int, str] = {}
#: The classes of the patterns, and a character of each; an exclamation mark stands for all the rest.
_CLASSES = ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\p{White_Space}", " "))


def odd_characters(text: str) -> dict[int, str] | None:
    """What to put in place of odd characters so that the pattern splits a text as the library does; None if it has none."""
    new = set(text) - _seen
    if new:
        from tokenizers import Regex, pre_tokenizers

        every = "".join(new)
        ours, theirs = dict.fromkeys(new, "!"), dict.fromkeys(new, "!")
        for kind, example in _CLASSES:
            ours.update(dict.fromkeys(regex.findall(kind, every), example))
            pieces = pre_tokenizers.Split(Regex(kind.replace("p{White_Space}", "s")), "removed", invert=True).pre_tokenize_str(every)
            theirs.update(dict.fromkeys("".join(p for p, _ in pieces), example))
        _odd.update({ord(c): theirs[c] for c in new if ours[c] != theirs[c]})
        _seen.update(new)
    return _odd if _odd and any(map(_odd.__contains__, map(ord, set(text)))) else None


@functools.cache
def _quick_words() -> re.Pattern:
    """WORD_PATTERN for texts without characters beyond U+FFFF: the re module looks spelled-out classes up in a table, and what begins most pre-tokens is tried first."""
    every = "".join(map(chr, range(1 << 16)))
    letter, number, white = ("".join(rf"\u{ord(run[0]):04x}-\u{ord(run[-1]):04x}" for run in regex.findall(kind + "+", every)) for kind, _ in _CLASSES)
    return re.compile(rf"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^{white}{letter}{number}]+")


@functools.cache
def _normalizer():
    """NFC and lower case exactly as the library does them for texts that are not ASCII."""
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


@functools.cache
def load(path: str) -> Vocabulary:
    """One copy for each Python worker."""
    return Vocabulary(path)


def ragged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all parts, and where each starts (one more start than parts)."""
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), starts
