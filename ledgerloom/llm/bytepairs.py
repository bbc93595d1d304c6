"""Byte-level BPE of whole texts, exactly as the ``tokenizers`` library gives it, with a bounded cache of chunks.

A text whose white space stands alone is cut at its spaces; the splitting pattern never looks across such a cut, so
chunks are encoded by themselves and remembered.  Texts with runs of white space are cut by the pattern itself.  Texts
with characters outside the plain ranges go to the library whole, as libraries differ in their character tables.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Character classes of the splitting pattern over the plain ranges below (fixed values).
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\\t-\\r \x85\xa0 -    "
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: A character outside of these is left to the library.
UNPLAIN = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")
#: White space other than spaces and line ends; texts with such are cut by the pattern.
RARE = ("\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")
#: White space beside a space: then cutting at spaces would part what the pattern takes together.
BESIDE = ("  ", " \n", "\n ")

CACHE_CHUNKS = 500_000


class BytePairs:
    """One vocabulary file of the ``tokenizers`` library with at most 65,536 ids, the GPT-2 pattern and no normaliser.

    Merges run in tiktoken, set up from the same vocabulary, as it takes long plain texts with little call overhead.
    """

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = byte_characters()
        base = {c: b for b, c in self.shown.items()}
        vocabulary = {token: i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        ranks = {bytes(base[c] for c in token): i for token, i in vocabulary.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merge = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_bytes = np.zeros(1 << 16, dtype=np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        self.chunks: dict[str, bytes] = {}  # text after a single space -> ids of both
        self.counts: dict[str, int] = {}  # piece of the pattern -> number of its ids

    def plain(self, text: str) -> bool:
        return (text.isascii() or not UNPLAIN.search(text)) and not any(s in text for s in self.special)

    def _merged(self, text: str) -> bytes:
        return array("H", self.merge(text)).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode chunks as one long text and cut the ids where the bytes of each chunk end."""
        ids = np.array(self.merge(" " + " ".join(new)), dtype=np.uint16)
        ends = np.cumsum([len(w.encode()) + 1 for w in new])
        cuts = (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1) * 2
        flat, at = ids.tobytes(), 0
        for w, cut in zip(new, cuts.tolist(), strict=True):
            self.chunks[w] = flat[at:cut]
            at = cut

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 16-bit numbers in the machine's order."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        out: list[bytes] = [b""] * len(texts)
        open_ = []
        known = self.chunks.get
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.plain(text):
                out[k] = array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            elif text[0] == " " or text[-1] == " " or any(s in text for s in BESIDE) or any(s in text for s in RARE):
                out[k] = self._merged(text)
            else:
                first, *rest = text.split(" ")
                open_.append((k, self._merged(first), rest, list(map(known, rest))))
        new = list({w for _, _, rest, ids in open_ if None in ids for w, x in zip(rest, ids, strict=True) if x is None})
        if new:
            self._learn(new)
        chunks = self.chunks
        for k, first, rest, ids in open_:
            out[k] = first + b"".join([chunks[w] if x is None else x for w, x in zip(rest, ids, strict=True)] if None in ids else ids)
        return out

    def ids(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def counted_pieces(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens of a text and the number of ids of each; special tokens' strings are ordinary text."""
        if len(self.counts) > CACHE_CHUNKS:
            self.counts.clear()
        if text.isascii() or not UNPLAIN.search(text):
            found = PIECES.findall(text)
        else:
            found = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        counts = self.counts
        sizes = list(map(counts.get, found))
        if None in sizes:
            for k, n in enumerate(sizes):
                if n is None:
                    piece = found[k]
                    if piece not in counts:
                        counts[piece] = len(self.tokenizer.model.tokenize("".join([self.shown[b] for b in piece.encode()])))
                    sizes[k] = counts[piece]
        return found, sizes


def byte_characters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies: itself, or the next unused one."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LOADED: dict[str, BytePairs] = {}


def byte_pairs(tokenizer_file: str) -> BytePairs:
    if tokenizer_file not in _LOADED:
        _LOADED[tokenizer_file] = BytePairs(tokenizer_file)
    return _LOADED[tokenizer_file]
