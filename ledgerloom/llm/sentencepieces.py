"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Words are runs of spaces with the text that follows; no piece of such a model crosses a word's start, so words are
encoded by themselves.  All new words of a batch are laid out in one flat array of symbols, and cut between characters
that are neighbours in no piece, as no merge can cross such a place: long words without spaces fall into many segments.
A round finds the best pair of each segment with a segmented minimum over pair ranks, merges it at all places where that
gives what merging leftmost first gives, and compacts the arrays; segments without a pair have left the arrays.  A word's
ids go to a cache, bounded by bytes, so that a round only sees words that the worker has not met.  Long words, as texts
without spaces are, go through the rounds each time; one of over ``CHUNK`` characters goes in parts between cuts.

Decoding reads ids alone.  A word's first id is a piece that begins with a space mark, so that no run of byte ids goes on
from one word to the next: what a text's ids decode to is what its words' ids decode to, one after the other, and those go
to the same cache.

Null or empty texts have no ids.  Repeated rows and ties give equal values; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import for_workers

SPACE = "▁"
#: About so many bytes of words and their ids does a worker remember; the cache starts anew beyond it.
CACHE_BYTES = 200_000_000
#: Longer words are encoded each time they are met: texts without spaces are words, and don't come again.
LONG = 64
#: Texts and words are worked off in groups of about so many characters; each takes some 150 bytes meanwhile.
CHUNK = 1 << 20
NONE = np.iinfo(np.int64).max

SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder for one model file of kind BPE with byte fallback and a dummy prefix."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.shown = [None if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.unknown = model.unk_id()
        self.size = size
        scores = np.array([model.get_score(i) for i in plain])
        rank = np.unique(-scores, return_inverse=True)[1]
        rank_of = dict(zip(plain, rank.tolist(), strict=True))
        # Characters that only occur inside pieces get symbols after the ids.
        self.symbol = dict(self.id_of)
        for p in self.id_of:
            for c in p:
                self.symbol.setdefault(c, size + len(self.symbol))
        self.width = max(self.symbol.values()) + 2
        self.other = self.width - 1  # a character in no piece: never merged
        found = {}
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    found[a * self.width + b] = (rank_of[i], i)
        keys = np.array(sorted(found), dtype=np.int64)
        self.pair_rank = np.array([found[k][0] for k in keys.tolist()] + [NONE], dtype=np.int64)
        self.pair_id = np.array([found[k][1] for k in keys.tolist()] + [0], dtype=np.int64)
        near = {self.symbol[a] * self.width + self.symbol[b] for p in self.id_of for a, b in zip(p, p[1:], strict=False)}
        self.neighbours = np.array([*sorted(near), NONE], dtype=np.int64)
        # A hash table without probing: each slot holds a short run of the keys, sorted by slot.
        self.bits = 20
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[order], -1)
        self.pair_rank[:-1], self.pair_id[:-1] = self.pair_rank[:-1][order], self.pair_id[:-1][order]
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.run = int(np.diff(self.first).max(initial=1))
        self.name = list(map(str, range(size)))
        self.words: dict[str, list[int]] = {}  # word -> its ids
        self.named: dict[str, str] = {}  # word -> its ids in decimal, joined by commas
        self.spoken: dict[str, str] = {}  # word -> what its ids decode to
        self.held = 0  # bytes of these, about

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables, the last place for pairs that make no piece."""
        key = left * self.width + right
        slot = self._slot(key)
        at, end = self.first[slot], self.first[slot + 1]
        found = np.full(len(key), len(self.keys) - 1, dtype=np.int64)
        open_ = np.flatnonzero(at < end)
        for step in range(self.run):
            here = at[open_] + step
            hit = self.keys[here] == key[open_]
            found[open_[hit]] = here[hit]
            open_ = open_[~hit & (here + 1 < end[open_])]
            if not len(open_):
                break
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, merged round by round over all words of a group."""
        out: list[list[int]] = []
        for group in grouped(words):
            if len(group) == 1 and len(group[0]) > CHUNK:
                out.append(list(chain.from_iterable(chain.from_iterable(map(self._encode, ([s] for s in self._slices(group[0])))))))
            else:
                out += self._encode(group)
        return out

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [self._ids(w, symbols) for w, symbols in zip(words, self._merge_rounds(words), strict=True)]

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        return np.array([self.symbol.get(chr(c), self.other) for c in distinct.tolist()], dtype=np.int64)[back]

    def _joined(self, symbols: np.ndarray) -> np.ndarray:
        """Which neighbours a merge could join."""
        key = symbols[:-1] * self.width + symbols[1:]
        return self.neighbours[np.searchsorted(self.neighbours, key)] == key

    def _slices(self, word: str) -> Iterator[str]:
        """A long word in parts of about ``CHUNK`` characters, cut where no merge can cross; longer where it can't be cut."""
        start, end = 0, CHUNK
        while end < len(word):
            window = max(start, end - CHUNK)
            cuts = np.flatnonzero(~self._joined(self._symbols(word[window : end + 1])))
            if len(cuts):
                cut = window + int(cuts[-1]) + 1
                yield word[start:cut]
                start, end = cut, cut + CHUNK
            else:
                end += CHUNK
        yield word[start:]

    def _merge_rounds(self, words: list[str]) -> list[list[int]]:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self._symbols("".join(words))
        word_of = np.repeat(np.arange(len(words)), lengths)
        joined = (word_of[1:] == word_of[:-1]) & self._joined(symbols)
        word = np.append(0, np.cumsum(~joined))  # from here on a word is a segment that merges can't leave
        starts_of = word_of[np.flatnonzero(np.append(True, ~joined))]  # the word that each segment is of
        done_word, done_symbol, done_at = [], [], []
        position = np.arange(len(symbols))
        while len(symbols):
            same = word[1:] == word[:-1]
            place = np.full(len(symbols), len(self.keys) - 1, dtype=np.int64)
            inner = np.flatnonzero(same)
            place[inner] = self._find(symbols[inner], symbols[inner + 1])
            rank = self.pair_rank[place]
            starts = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(symbols)))
            best_here = np.repeat(best, spans)
            over = best_here == NONE
            if over.any():  # words without a pair leave the arrays
                done_word.append(word[over])
                done_symbol.append(symbols[over])
                done_at.append(position[over])
                keep = ~over
                symbols, word, position, place, rank, best_here = (x[keep] for x in (symbols, word, position, place, rank, best_here))
                if not len(symbols):
                    break
            chosen = rank == best_here
            at = np.flatnonzero(chosen)
            # Of pairs that overlap, every second one from the left; runs are broken where a gap or a new word begins.
            gap = np.append(True, np.diff(at) > 1)
            run_start = np.maximum.accumulate(np.where(gap, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            merged = self.pair_id[place[at]]
            new = symbols.copy()
            new[at] = merged
            drop = np.zeros(len(symbols), dtype=bool)
            drop[at + 1] = True
            keep = np.flatnonzero(~drop)
            # A pair made by this round that ranks before or with it would have come first: such words take one merge.
            s, w = new[keep], word[keep]
            touched = np.zeros(len(symbols), dtype=bool)
            touched[at] = True
            t = touched[keep]
            near = np.flatnonzero((w[1:] == w[:-1]) & (t[1:] | t[:-1]))
            early = near[self.pair_rank[self._find(s[near], s[near + 1])] <= best_here[keep][near]]
            if len(early):
                careful = np.zeros(len(starts_of), dtype=bool)
                careful[w[early]] = True
                first = np.append(True, word[at][1:] != word[at][:-1])
                at = at[first | ~careful[word[at]]]
                new = symbols.copy()
                new[at] = self.pair_id[place[at]]
                drop[:] = False
                drop[at + 1] = True
                keep = np.flatnonzero(~drop)
            symbols, word, position = new[keep], word[keep], position[keep]
        word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
        order = np.argsort(np.concatenate(done_at)) if done_at else word
        word, symbols = starts_of[word[order]], (np.concatenate(done_symbol)[order] if done_symbol else word)
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        flat = symbols.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, word: str, symbols: list[int]) -> list[int]:
        if max(symbols) < self.size:
            return symbols
        ids, at = [], 0
        for s in symbols:
            if s < self.size:
                ids.append(s)
                at += len(self.pieces[s])
            else:  # a character without a piece: its bytes
                ids += [self.byte_id.get(b, self.unknown) for b in word[at].encode()]
                at += 1
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: runs of byte ids are read as UTF-8, the dummy prefix goes."""
        return self._strip(self._text(ids))

    def _text(self, ids: list[int]) -> str:
        shown = list(map(self.shown.__getitem__, ids))
        if None not in shown:
            return "".join(shown)
        out, raw = [], bytearray()
        for i, text in zip(ids, shown, strict=True):
            if text is None:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            out.append(text)
        return "".join(out) + raw.decode(errors="replace")

    @staticmethod
    def _strip(text: str) -> str:
        return text[1:] if text[:1] == " " else text

    #: Space runs with what follows, in a text whose spaces are marked.
    WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the marks of its leading spaces but one where a single space leads it."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        # One leading mark is implied in both forms, so that they share the cache; other words keep all marks after it.
        return [w[1:] for w in self.WORD.findall(marked)]

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the decoded text, for each text."""
        for group in grouped(texts):
            for row, (_, named, spoken) in self.known(group):
                joined, decoded = ",".join(map(named, row)), self._strip("".join(map(spoken, row)))
                yield joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def known(self, texts: list[str]) -> Iterator[tuple[list[str], tuple]]:
        """The words of each text, and what gives a word's ids, their names and what they decode to."""
        rows = [self.split(t) for t in texts]
        if self.held > CACHE_BYTES:
            for cache in (self.words, self.named, self.spoken):
                cache.clear()
            self.held = 0
        new = list(set(chain.from_iterable(rows)).difference(self.words))
        own: tuple[dict, dict, dict] = ({}, {}, {})  # long words, of these texts only
        for w, ids in zip(new, self.encode_words([SPACE + w for w in new]), strict=True):
            words, named, spoken = own if len(w) > LONG else (self.words, self.named, self.spoken)
            words[w], named[w], spoken[w] = ids, ",".join([self.name[i] for i in ids]), self._text(ids)
            if len(w) <= LONG:
                self.held += 400 + 6 * len(w) + 45 * len(ids)
        if own[0]:
            find = tuple((lambda w, a=a, b=b: a[w] if w in a else b[w]) for a, b in zip(own, (self.words, self.named, self.spoken), strict=True))
        else:
            find = (self.words.__getitem__, self.named.__getitem__, self.spoken.__getitem__)
        return ((row, find) for row in rows)

    def encode_texts(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for group in grouped(texts):
            for row, (words, _, _) in self.known(group):
                yield list(chain.from_iterable(map(words, row)))


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``CHUNK`` characters together, or a single longer one."""
    held: list[str] = []
    n = 0
    for t in texts:
        if held and n + len(t) > CHUNK:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` with n_tokens, ids_sha256 and decoded_sha256 of every text.  No shuffle; one pass over the input."""
    for_workers(docs.sparkSession)
    docs = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = list(own.digest(texts))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"`{id_column}` {kind}, {SCHEMA}")


def token_ids(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` with the array of ids of every text, for training."""
    for_workers(docs.sparkSession)
    docs = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            rows = list(own.encode_texts([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return docs.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
