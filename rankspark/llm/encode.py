"""Token ids of texts by a public tokenizer file, memoised by white-space separated chunk.

Tokenizers that drop white space and never join over it give a text's ids as the concatenation
of its chunks' ids.  Invented words repeat, so most chunks are found in a bounded memo; the rest
go to the library.  Files for which this does not hold (sentencepiece models, byte-level
vocabularies) are encoded text by text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

MEMO_WORDS, MEMO_CHUNKS = 600_000, 100_000  # bounds of the memos; a miss costs time, never a result
#: Latin letters that lower-case one by one and keep their form under NFC, between runs of ASCII marks.
#: No apostrophe stands before the letters, where the tokenizer would join it to them.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]*)([!-/:-@\[-`{-~]*)")
#: Runs of these alone lower-case letter by letter; single marks among them are tokens of their own.
_EASY = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž \n\r\t.,]*")
_EASY_PIECE = re.compile(r"[^\s.,]+|[.,]")
_LETTERS = re.compile(r"[a-zß-öø-įı-ňŋ-ž]+")
_MARK_RUN = (".,", ",.", "..", ",,")
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile("[\\S\x1c-\x1f]+")


def chunks_of(text: str) -> list[str]:
    """White-space separated chunks; the four ASCII separators are text to the tokenizer, not space."""
    return _CHUNK.findall(text) if _NOT_SPACE.search(text) else text.split()


class Encoder:
    """``ids(text)`` as little-endian bytes of ``dtype``, and ``counts(text)`` per chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.piece = path.endswith(".model")
        if self.piece:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.model.vocab_size()
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_padding()
            self.model.no_truncation()
            self.size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.by_chunk = not self.piece and self._drops_space()
        self.letters: dict[int, str] = {}
        self.merge_alone = self.by_chunk and self._merge_model_suffices()
        self.added = [] if self.piece else [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _drops_space(self) -> bool:
        one = self.direct
        return one(" \n\t") == [] and all(
            one(f"{a} {b}") == one(a) + one(b) == one(f" {a}\n\n{b} ") for a, b in (("ab", "cd"), ("It's", "re"), ("x", ".")))

    def _merged(self, word: str) -> list[int]:
        return [t.id for t in self.model.model.tokenize(word.translate(self.letters))]

    def _merge_model_suffices(self) -> bool:
        """Lower-case Latin words need no normalising: with their letters in the vocabulary's byte
        alphabet, the merge model alone gives their ids."""
        split = self.model.pre_tokenizer.pre_tokenize_str
        for ch in filter(_LETTERS.fullmatch, map(chr, range(0xDF, 0x17F))):
            self.letters[ord(ch)] = split(ch)[0][0]
        return all(self._merged(w) == self.direct(w) for w in ("a", "zebra", "qxzvtt", "éçole", "straße", "ñandú", "łódź"))

    def direct(self, text: str) -> list[int]:
        """The library's own answer for a whole text."""
        return self.model.encode(text) if self.piece else self.model.encode(text, add_special_tokens=False).ids

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= MEMO_WORDS:
                self.words.clear()
            alone = self.merge_alone and _LETTERS.fullmatch(word)
            ids = self._merged(word) if alone else self.direct(word)
            got = self.words[word] = self._pack(ids)
        return got

    def _chunk(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain is None or any(name in chunk for name in self.added):
            got = self._pack(self.direct(chunk))
        else:
            before, word, after = plain.groups()
            parts = (before, word.lower(), after) if word else (before + after,)
            got = b"".join(self._word(p) for p in parts if p)
        if len(self.memo) < MEMO_CHUNKS:
            self.memo[chunk] = got
        return got

    def _easy(self, text: str) -> list[bytes] | None:
        """Ids by lower-cased word for plain Latin prose, else None."""
        if _EASY.fullmatch(text) is None or any(run in text for run in _MARK_RUN):
            return None
        get, word = self.words.get, self._word
        return [got if (got := get(w)) is not None else word(w)
                for w in text.lower().replace(",", " , ").replace(".", " . ").split()]

    def _line(self, text: str) -> list[bytes]:
        easy = self._easy(text)
        if easy is not None:
            return easy
        get = self.memo.get
        return [got if (got := get(c)) is not None else self._chunk(c) for c in chunks_of(text)]

    def pieces(self, text: str) -> list[bytes]:
        """Packed ids by word, mark or chunk where the file allows it."""
        if not self.by_chunk:
            return [self._pack(self.direct(text))] if text else []
        easy = self._easy(text)
        return easy if easy is not None else [p for line in text.split("\n") for p in self._line(line)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the pieces stand in the text, piece by piece."""
        if not self.by_chunk:
            return [(0, len(text))] if text else []
        if self._easy(text) is not None:
            return [m.span() for m in _EASY_PIECE.finditer(text)]
        found, at = [], 0
        for line in text.split("\n"):
            piece = _EASY_PIECE if self._easy(line) is not None else _CHUNK
            found += [(at + a, at + b) for a, b in (m.span() for m in piece.finditer(line))]
            at += len(line) + 1
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(self.pieces(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Where a public tokenizer file is on this machine; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
