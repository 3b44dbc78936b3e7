"""Public tokenizers, loaded once per Python worker from a path that the caller gives."""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np

#: White space as Unicode's White_Space property has it.
_SPACE = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_BATCH_CHARS = 1 << 20


@lru_cache(1)
def char_class() -> np.ndarray:
    """Class of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            out[c] = LETTER if k == "L" else NUMBER
    out[_SPACE] = SPACE
    return out


@lru_cache(4)
def byte_bpe(path: str):
    """A tiktoken encoding from a file of ranks, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordBpe:
    """The ids that the tokenizers library gives for a lower-casing BPE with word ends, several times as fast.

    The vocabulary's merges become ranks for tiktoken's merge loop. The word end is the letter A, which no
    lower-cased text has: A after a word's last byte merges first, and what it makes is the symbol with
    the suffix from which the vocabulary's own merges start. Words are found for a whole batch at once.
    """

    END = b"A"

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}

        def as_bytes(token: str) -> bytes:
            end = token.endswith(suffix) and len(token) > len(suffix)
            return bytes(alphabet[c] for c in (token[: -len(suffix)] if end else token)) + self.END * end

        ranks, ids = {}, {}
        for b in range(256):
            ranks[bytes([b, self.END[0]])] = b  # first of all
            ranks[bytes([b])] = 1_000_000 + b  # never made by a merge
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[as_bytes(a + b)] = 1000 + i
        for token, i in vocab.items():
            if all(c in alphabet for c in token.removesuffix(suffix)):
                ids[as_bytes(token)] = i
        self._id = np.full(1_000_256, -1, np.int64)
        for token, r in ranks.items():
            if token in ids:
                self._id[r] = ids[token]
        self._bpe = tiktoken.Encoding("word", pat_str=r"[^A]+A", mergeable_ranks=ranks, special_tokens={})
        self._word = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # letter by letter: a capital sigma becomes the same letter wherever it stands
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _marked(self, texts: list[str]) -> list[str]:
        """Each normalised text without its spaces, A after every word."""
        sep = "B"
        code = np.frombuffer((sep.join(texts) + sep).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = char_class()[code]
        between = code == ord(sep)
        kind[between] = SPACE
        last = kind != SPACE
        last[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == NUMBER)
        keep = (kind != SPACE) | between
        width = keep.astype(np.int64) + last
        at = np.cumsum(width) - width
        out = np.full(int(width.sum()), ord("A"), np.uint32)
        out[at[keep]] = code[keep]
        return out.tobytes().decode("utf-32-le", "surrogatepass").split(sep)[:-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n < _BATCH_CHARS):
                n += len(texts[j])
                j += 1
            normal = [self.normal(t) for t in texts[i:j]]
            # an apostrophe may start a contraction, which the pattern knows
            plain = iter(self._marked([t for t in normal if "'" not in t]))
            for t in normal:
                marked = "".join(w + "A" for w in self._word.findall(t)) if "'" in t else next(plain)
                out.append(self._id[self._bpe.encode_to_numpy(marked)] if marked else np.zeros(0, np.int64))
            i = j
        return out


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
