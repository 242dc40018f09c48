"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A word is a row of symbols: its bytes, the last one marked as the word's end. An Aho-Corasick
automaton over all tokens gives the tokens that start at each place. The encoder takes the longest;
a token may follow another only if the merges would leave that pair as it is, which a walk down the
two tokens' merges decides (and a table remembers). Where no token fits, it steps back and takes
the next shorter one; a place that was stepped back from is never entered again, so the work is
linear. The result is that of applying the merges in rank order.

Decoding gathers the tokens' strings from one buffer by an offset table.

Ids of words are remembered per worker, up to a bound. Texts with characters on which Unicode
versions could disagree are normalised and split by the tokenizers library; the merges are always
done here.

Defined results: null text is the empty text, with no ids and an empty decoded text; an added
token's string in a text gives its id; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, ship, tidied

#: Words and pieces that a worker remembers before it starts anew.
WORDS, PIECES = 120_000, 120_000
END = "</w>"


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


class Encoder:
    """path: a tokenizer file of a BPE model with byte-level pieces and the word-end suffix."""

    _kept: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != END or model["type"] != "BPE" or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("not a BPE model with word ends")
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(self.pattern).findall
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")").split
        vocab: dict[str, int] = model["vocab"]
        # A symbol is a character of the vocabulary, or that character with the word's end after it,
        # for which one private character stands.
        chars = byte_chars()
        self.of_byte = [chars[b] for b in range(256)]
        self.last = {c: chr(0xE000 + b) for b, c in chars.items()}
        self.back = {c: b for b, c in chars.items()}

        def symbols(token: str) -> str:
            return token[: -len(END) - 1] + self.last[token[-len(END) - 1]] if token.endswith(END) else token

        self.length: dict[int, int] = {}
        by_symbols: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            s = symbols(token)
            by_symbols[s] = i
            self.length[i] = len(s)
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        #: The longest token that a token properly starts with.
        self.shorter: dict[int, int] = {}
        for s, i in by_symbols.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := by_symbols.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.by_symbols = by_symbols
        #: Of a merge's result: its rank and its two parts; of parts: the merge's rank.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge[i, j] = rank
            self.rank.setdefault(k, rank)
            self.parts.setdefault(k, (i, j))
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # The offset table: each id's string and a space.
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        rows = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.cumsum([0, *map(len, rows)])
        self.buffer = np.frombuffer(b"".join(rows), np.uint8)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept = {path: cls(path)}
        return cls._kept[path]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a, b side by side: no merge across the border comes before those
        that make the two tokens' outer parts. Walks down the later-made of the two each time."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, limit, ok = a, b, len(self.merge), True
        while True:
            across = self.merge.get((x, y))
            if across is not None and across < limit:
                ok = False
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            # A merge across beats one of the same rank to its right, but not one to its left.
            if rx > ry:
                limit, x = rx, self.parts[x][1]
            else:
                limit, y = ry + 1, self.parts[y][0]
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def merge_word(self, word: str) -> list[int]:
        """Ids of a word given as symbols."""
        whole = self.by_symbols.get(word)
        longest: list[int] = [-1] * len(word)
        size = [0] * len(word)
        for end, (i, n) in self.automaton.iter(word):
            at = end - n + 1
            if n > size[at]:
                longest[at], size[at] = i, n
        if whole is not None and len(word) == 1:
            return [whole]
        out: list[int] = []
        open_ = [True] * (len(word) + 1)
        at, token = 0, longest[0]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        while True:
            last = out[-1] if out else None
            while True:
                end = at + length[token]
                if open_[end] and (last is None or compatible(last, token)):
                    out.append(token)
                    at = end
                    break
                less = shorter.get(token)
                if less is None:
                    open_[at] = False
                    if last is None:
                        raise ValueError(f"no tokens for {word!r}")
                    out.pop()
                    at -= length[last]
                    token = last
                    last = out[-1] if out else None
                    continue
                token = less
            if at == len(word):
                return out
            token = longest[at]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of normalised text."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            chars = [self.of_byte[b] for b in piece.encode()]
            chars[-1] = self.last[chars[-1]]
            ids = self.pieces[piece] = array("I", self.merge_word("".join(chars))).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" in text and any(a in text for a in self.added):
            return b"".join(array("I", [self.added[part]]).tobytes() if part in self.added else self.encode(part) for part in self.cut(text) if part)
        if PLAIN(text):
            found = text.lower().split()
            try:
                return b"".join(map(self.words.__getitem__, found))
            except KeyError:
                pass
            words, piece = self.words, self.piece
            if len(words) > WORDS:
                words.clear()
            for w in {w for w in found if w not in words}:
                words[w] = b"".join([piece(p) for p in self.split(w)])
            return b"".join([words[w] for w in found])
        norm = self.tokenizer.normalizer.normalize_str(text)
        back = self.back
        return b"".join(self.piece(bytes(back[c] for c in p).decode()) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm))

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8: the tokens' strings with a space between."""
        out = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i : i + (1 << 18)]
            start = self.offsets[part]
            n = self.offsets[part + np.uint32(1)] - start
            stop = np.cumsum(n)
            out.append(self.buffer[np.repeat(start - stop + n, n) + np.arange(stop[-1])].tobytes())
        return b"".join(out)[:-1]


def _run(path: str, full: bool):
    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            decoded = [encoder.decode(np.frombuffer(i, np.uint32)) for i in ids]
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            if full:
                last = [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())]
            else:
                last = [pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *last], ("doc_id", "n_tokens", "ids", "decoded"))

    return run


def bpe(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(_run(tokenizer_path, True)), "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), without sending ids and texts back to the JVM."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidied(_run(tokenizer_path, False)), "doc_id long, n_tokens long, ids string, decoded string")
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
