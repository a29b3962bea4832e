"""Token ids of texts by a public tokenizer file, with a per-worker cache of words.

``word_bpe_49k.json`` composes characters (NFC), lower-cases, splits at white space and then into runs of
letters, single digits and runs of other marks. None of these steps looks across white space, so the ids
of a text are those of its words one after another; a run of letters is encoded once per worker. Texts that hold
a special token of the file, or a control character on whose nature as white space the libraries
disagree, are encoded whole. The tests hold both against the library on whole texts.
"""

from __future__ import annotations

import array
import json
import re
from itertools import filterfalse

import numpy as np

WORD_TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 800_000
#: Pre-tokens that are encoded in one call, one after another.
LINE = 500

_loaded: dict[str, WordTokenizer] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; an absolute path is taken as it is."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str = WORD_TOKENIZER) -> WordTokenizer:
    """The tokenizer of that name; a worker reads it once."""
    if name not in _loaded:
        _loaded[name] = WordTokenizer(tokenizer_path(name))
    return _loaded[name]


#: Letters and numbers that lower-case Latin text can hold, up to U+024F before lower-casing.
LETTERS, NUMBERS = r"a-zªµºß-öø-\u02af\u2c65\u2c66", "0-9²³¹¼½¾"


# The rules of a file by which words can be encoded apart. Texts for files of other rules are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splits_at_words(path: str) -> bool:
    """Whether the file has the rules that ``WordTokenizer`` knows."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    split = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    model = rules["model"]
    return rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == split and (model.get("type"), model.get("end_of_word_suffix")) == ("BPE", "</w>")


class WordTokenizer:
    """Encodes a text by its words, each of which is looked up or encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.by_words = splits_at_words(path)
        self.whole = Tokenizer.from_file(path)
        self.odd = [*map(chr, range(0x1C, 0x20)), *(t.content for t in self.whole.get_added_tokens_decoder().values())]
        #: Characters that lower() and NFC treat alike in Python and in the library.
        self.beyond = re.compile(r"[^\x00-\u012f\u0131-\u024f]").search
        self.split = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}{NUMBERS}]+").findall
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Ids of pre-tokens, and of words as they stand in a text, which have a space before them.
        self.known: dict[str, bytes] = {}

    def _exact(self, text: str) -> bytes:
        return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _keys(self, text: str) -> list[str] | None:
        """What the text is made of, or None if it is to be encoded whole."""
        if not self.by_words or any(x in text for x in self.odd):
            return None
        if not self.beyond(text):
            return self.split(text.lower())
        keys: list[str] = []
        for word in text.split():
            if self.beyond(word):
                keys.append(" " + word)
            else:
                keys += self.split(word.lower())
        return keys

    def _learn(self, missing: set[str]) -> None:
        parts = [k for k in missing if k[0] != " "]
        for k in range(0, len(parts), LINE):
            line = parts[k : k + LINE]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) == len(line):
                data = ids.tobytes()
                self.known.update(zip(line, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:
                self.known |= {part: self._exact(part) for part in line}
        self.known |= {k: self._exact(k[1:]) for k in missing if k[0] == " "}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers, without special tokens added."""
        out = []
        for text in texts:
            keys = self._keys(text)
            if keys is None:
                out.append(self._exact(text))
                continue
            missing = set(filterfalse(self.known.__contains__, keys))
            if missing:
                if len(self.known) + len(missing) > CACHE_WORDS:
                    self.known.clear()
                    missing = set(keys)
                self._learn(missing)
            out.append(b"".join(map(self.known.__getitem__, keys)))
        return out
