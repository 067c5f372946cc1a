"""Encoding of texts with the library of a public vocabulary file, inside tasks."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# What the pre-tokenizer of the word-end vocabulary does to texts of these characters alone is a plain
# regular expression over lower-case text; NFC leaves them as they are. Fixed values of the vocabulary file.
_PLAIN = re.compile("[\t\n\r -~¡«»¿À-ÿŒœ–—‘-„…]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿœ]+")
_CACHED = 300_000                        # pieces held by a worker, about 60 MB


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, exactly as the tokenizers library gives them.

    The library's normalisation and pre-tokenisation take most of its time, and words repeat. So a text is
    split where both are known to split it: into pre-tokens if it has plain characters only, else at ASCII
    white space. Each new piece is encoded by the library; a bounded dictionary remembers it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.library, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model = self.library.model

    def __missing__(self, piece: str) -> bytes:
        word = piece.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
        if len(self) >= _CACHED:
            self.clear()
        self[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join([self[p] for p in _PIECE.findall(text.lower())])

    def encode(self, text: str) -> bytes:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self._plain(text)
        parts, odd = [], {}
        for chunk in re.split("[ \t\n\r]+", text):
            if "<|" not in chunk and _PLAIN.fullmatch(chunk):
                parts.append(self._plain(chunk))
            else:
                odd[len(parts)] = chunk
                parts.append(b"")
        for at, e in zip(odd, self.library.encode_batch_fast(list(odd.values()), add_special_tokens=False)):
            parts[at] = np.array(e.ids, "<u4").tobytes()
        return b"".join(parts)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process and file, kept between tasks."""
    return WordEncoder(path)


class PieceEncoder:
    """Token ids and character offsets of a sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        byte = [int(p[3:5], 16) if self.library.is_byte(i) else -1 for i, p in enumerate(pieces)]
        self.chars = np.array([len(p) if b < 0 else int(b < 0x80 or b >= 0xC0) for p, b in zip(pieces, byte)], np.int64)
        self.inside = {p[i:i + 2] for p, b in zip(pieces, byte) if b < 0 for i in range(len(p) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def boundaries(self, text: str) -> np.ndarray:
        """Where each token begins and the last one ends. The library puts a space before the text: a token
        that holds this space alone begins and ends at 0."""
        return np.maximum(np.concatenate([[0], np.cumsum(self.chars[self.library.encode(text, num_threads=1)])]) - 1, 0)

    def apart(self, text: str, at: int) -> bool:
        """Proof that no token spans this place: no piece of the vocabulary has these two characters in a
        row, and every merge makes a piece of the vocabulary."""
        return text[at - 1:at + 1].replace(" ", "▁") not in self.inside


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
