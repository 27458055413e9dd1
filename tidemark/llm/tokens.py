"""Token ids by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice
from struct import pack

#: Words kept with their ids in each Python worker (some 200 bytes each). A full store keeps the half that came first: common words come early.
KEPT_WORDS = 1_000_000
LONG_WORD = 64
# Letters and the punctuation after them are always different pre-tokens, so each is looked up alone. The apostrophe is not among it.
SPLIT = re.compile(r"([a-zß-öø-ÿÀ-ÖØ-Þ]+)([!-&(-/:-@\[-`{-~]+)")
# Words of these letters are one pre-token; normalising only lower-cases them, letter by letter.
PLAIN = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")
# The special tokens begin like this. They are looked for before lower-casing, so texts with it are encoded whole.
SPECIAL = "<|"


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class KeptWords(dict):
    """Words and their ids; a word that is not there yet is encoded when it is asked for."""

    def __init__(self, encode, words=()):
        super().__init__(words)
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        parts = SPLIT.fullmatch(word.decode()) if len(word) <= LONG_WORD else None
        ids = b"".join([self[x.encode()] for x in parts.groups()]) if parts else self.encode(word.decode())
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts as the tokenizer does, without special tokens, as little-endian unsigned 32-bit ids.

    Made for tokenizers that lower-case and drop white space, as ``word_bpe_49k.json`` does: there a text's ids are those of
    its words one after the other, so each distinct word is encoded once and kept. Another tokenizer gets ``by_word=False``.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.model, self.written = self.tokenizer.model, byte_characters()
        tried = ["the", "zß", "éclair", "ÿäö", "word", "Écoles", "þÞ"]
        self.direct = by_word and [self._plain(x) for x in tried] == self._ids(tried)
        self.kept = KeptWords(self._word)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [pack(f"<{len(x.ids)}I", *x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, word: str) -> bytes:
        """The model alone on a word of plain letters: several times as fast as normalising and splitting it first."""
        word = word.lower()
        found = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.written))
        return pack(f"<{len(found)}I", *[x.id for x in found])

    def _word(self, word: str) -> bytes:
        return self._plain(word) if self.direct and PLAIN.fullmatch(word) else self._ids([word])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self._ids([x or "" for x in texts])
        out = []
        for text in texts:
            text = text or ""
            if len(self.kept) > KEPT_WORDS:
                self.kept = KeptWords(self._word, islice(self.kept.items(), KEPT_WORDS // 2))
            if SPECIAL in text:
                out += self._ids([text])
            else:
                out.append(b"".join(map(self.kept.__getitem__, text.encode().lower().split())))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool = True) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path, by_word)
