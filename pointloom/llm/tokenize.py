"""Token ids of whole texts by a public tokenizer file, inside Arrow batches.

The words of a corpus repeat, so ids are remembered by word: a text of plain
letters, digits and punctuation is split into words and these are looked up; only
unseen words reach the merge table.  That is right only for a file whose settings
are ``SETTINGS``; they are read from the file.  Any text of another file, and a
text with anything else in it (control characters, combining marks, other scripts,
strings of special tokens), goes through ``Tokenizer.encode`` as a whole.  Both
ways give the same ids; the tests compare them.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The word pattern of word_bpe_49k.json, in ``re`` syntax for
#: the characters of PLAIN, where letters are ``[^\W\d_]`` and digits ``\d``.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: The same with the commonest alternative first; they begin with different characters.
FAST_WORDS = r"[^\W\d_]+|\d|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+"
#: The same for lower-cased ASCII.
ASCII_WORDS = r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~]+"
#: Characters on which ``re``, ``str.lower`` and the tokenizer agree.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-įĲ-ž‐-―‘-‟€]*"
#: The settings of a file whose words may be remembered.
SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}
#: Words in each of the two generations that one Python worker keeps in memory.
MOST_WORDS = 100_000
#: Characters of all words of a generation, so that long words cannot fill a worker; a text's own words are held besides.
MOST_LETTERS = 2_000_000


def words_are_known(path: str) -> bool:
    """Whether the file has the settings for which words can be split here and remembered."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    return (
        all(found.get(k) == v for k, v in SETTINGS.items())
        and all(found["model"].get(k) == v for k, v in MODEL.items())
        and all(t["content"].startswith("<|") for t in found["added_tokens"])
    )


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for byte in range(256):
        letters.append(chr(byte if byte in shown else spare))
        spare += byte not in shown
    return letters


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes.

    Words are remembered in two generations: when the newer one is full it becomes the
    older one, from which words that occur again come back, and what is older is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.remembers = words_are_known(path)
        self.find = re.compile(FAST_WORDS).findall
        self.find_ascii = re.compile(ASCII_WORDS).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters_known = 0

    def _learn(self, words: set[str]) -> None:
        """Let ``known`` have all of ``words``."""
        new = words.difference(self.known)
        size = sum(map(len, new))
        if len(self.known) + len(new) > MOST_WORDS or self.letters_known + size > MOST_LETTERS:
            self.older, self.known, self.letters_known = self.known, {}, 0
            new, size = words, sum(map(len, words))
        for word in new:
            ids = self.older.get(word)
            if ids is None:
                shown = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
                ids = np.array([token.id for token in self.model.tokenize(shown)], "<u4").tobytes()
            self.known[word] = ids
        self.letters_known += size

    def ids(self, text: str) -> bytes:
        if not self.remembers or not self.plain(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = (self.find_ascii if text.isascii() else self.find)(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(set(words))
            found = b"".join(map(self.known.__getitem__, words))
        if len(self.known) > MOST_WORDS or self.letters_known > MOST_LETTERS:  # this text alone is larger
            self.known, self.letters_known = {}, 0
        return found


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; its words stay known between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
