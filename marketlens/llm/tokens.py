"""Token ids of whole texts by a public tokenizer of the `tokenizers` library, with a bounded word cache.

The tokenizer read here drops white space, lower-cases, and never joins characters across white space, so the ids of a
text are those of its words in turn. Words repeat far more than texts do: each worker process keeps the ids of up to twice
CACHE words (or as many as are asked for), from one task to the next; when so many words are new, those not met since the last
time are forgotten, and all are when the worker goes over to other work. Words of ASCII and Latin-1 letters go straight to the
vocabulary's merge model; any other word, and any text with the four control characters that Python alone takes for white space, goes through the whole tokenizer. So does every
text if the vocabulary's file names another normaliser, pre-tokenizer or model than those this rests on.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
from tokenizers import Tokenizer

from marketlens.llm.common import KEPT

#: Words of a generation; two generations are kept by a worker.
CACHE = 200_000
#: The tokenizer's own pattern, for plain characters, and the characters that it counts as plain here.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The parts of a tokenizer's file for which a text's ids are those of its words.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_words(settings: dict) -> bool:
    """Whether a tokenizer's settings are those known here."""
    return all(settings[k] == v for k, v in KNOWN.items()) and settings["model"]["type"] == "BPE" and not settings["model"]["dropout"]


def _byte_letters() -> str:
    """The printable characters that stand for the bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return "".join(letters[b] for b in range(256))


class _Words:
    """Ids of words, all in one array."""

    def __init__(self, kind: type, most: int):
        self.place: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 20, kind), 0
        self.starts, self.sizes = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)

    def add(self, words: list[str], ids: list[list[int]]) -> None:
        k, sizes = len(self.place), np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.pool.dtype, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(flat)), self.pool.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.sizes[k : k + len(ids)] = sizes
        self.starts[k : k + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.place.update(zip(words, range(k, k + len(ids)), strict=True))
        self.used += len(flat)

    def ids(self, k: int) -> list[int]:
        return self.pool[self.starts[k] : self.starts[k] + self.sizes[k]].tolist()


class WordTokenizer:
    """encode(texts) gives the ids of all texts end to end, and how many each has."""

    def __init__(self, path: str, words: int | None = None):
        self.most = words or CACHE
        self.full = Tokenizer.from_file(path)
        self.by_words = by_words(json.loads(self.full.to_str()))
        self.model, self.letters = self.full.model, _byte_letters()
        self.specials = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.wide = np.uint16 if self.full.get_vocab_size() <= 1 << 16 else np.uint32
        self.now, self.past = _Words(self.wide, self.most), _Words(self.wide, self.most)

    def _word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [t.id for t in self.model.tokenize(word.lower())]
        if word[-1] in ".,;:!?" and (stem := word[:-1]).isascii() and stem.isalpha():
            k = self.now.place.get(stem)
            return (self._word(stem) if k is None else self.now.ids(k)) + [t.id for t in self.model.tokenize(word[-1])]
        if not PLAIN.fullmatch(word) or "<" in word and any(s in word for s in self.specials):
            return self.full.encode(word, add_special_tokens=False).ids
        word = word.lower()
        ids: list[int] = []
        for piece in [word] if word.isalpha() else PIECES.findall(word):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(piece)]
        return ids

    def _of_words(self, words: list[str]) -> np.ndarray:
        """Ids of all words end to end."""
        at = np.fromiter(map(self.now.place.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.nonzero(at < 0)[0]):
            new = list({words[i] for i in missing.tolist()})
            if len(self.now.place) + len(new) > self.most:
                self.past, self.now = self.now, _Words(self.wide, self.most)
                return self._of_words(words)
            known = self.past.place
            self.now.add(new, [self._word(w) if (k := known.get(w)) is None else self.past.ids(k) for w in new])
            at[missing] = np.fromiter((self.now.place[words[i]] for i in missing.tolist()), np.int64, len(missing))
        sizes = self.now.sizes[at]
        shift = np.repeat(self.now.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        return self.now.pool[shift + np.arange(len(shift))]

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words or ODD_SPACE.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, self.wide)
        if "<|" not in text and "\u03a3" not in text:  # but for a capital sigma, whose lower case depends on its place
            text = text.lower()
        words = text.split()
        if not words:
            return np.empty(0, self.wide)
        step = self.most // 8
        return np.concatenate([self._of_words(words[k : k + step]) for k in range(0, len(words), step)])


@lru_cache(maxsize=2)
def tokenizer(path: str, words: int | None = None) -> WordTokenizer:
    """This process's tokenizer for a vocabulary, which keeps its words from task to task."""
    return WordTokenizer(path, words)


KEPT.append(tokenizer.cache_clear)
