"""Byte-pair encoding and decoding by batched numpy merge rounds.

A text is composed (NFC) and lower-cased, and becomes code points; runs of one
character class, single digits and contractions ('s, 't, 're ...) are its words.
Each distinct word is encoded once: the symbols of many words lie in one flat
array, every round finds each word's lowest-ranked pair by binary search over
the sorted pair keys and merges it everywhere in the word, until no word has a
pair left.  Ids of a text are the ids of its words, gathered.

Special-token strings are cut out of the text first and keep their own ids.
Nulls and empty texts give no ids.  Only texts with a code point that this
Python's Unicode data doesn't know, whose class and lower case are therefore
unknown, take the tokenizer library's own path.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

LETTER, DIGIT, SPACE, OTHER, BREAK, UNKNOWN = range(6)
#: A noncharacter between texts.
GAP = chr(0x10FFFF)
#: What follows the apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join("\0" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[np.fromiter((unicodedata.category(c) == "Cn" for c in every), bool, len(every))] = UNKNOWN
    out[ord(GAP)] = BREAK
    return out


@functools.cache
def point_hashes() -> np.ndarray:
    return T._symbol_table(0x110000, fold=False)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in keep)}
    return [chr(rest.get(b, b)) for b in range(256)]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, a gap after each, and the starts of the texts."""
    data = np.frombuffer((GAP.join(texts) + GAP).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.concatenate([[0], np.cumsum(lengths)])


def normal(text: str) -> str:
    """Composed and lower-cased, every character by itself (a final sigma is no other)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def word_edges(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a word (or a run between words) starts at each code point."""
    edge = np.ones(len(data), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # An apostrophe that starts a run and the letters of a contraction are one word; what letters follow start the next.
    quote = np.flatnonzero((data == ord("'")) & edge)
    for tail in CONTRACTIONS:
        at = quote[quote + len(tail) < len(data)]
        for k, c in enumerate(tail):
            at = at[data[at + 1 + k] == ord(c)]
        edge[at + 1] = False
        after = at + 1 + len(tail)
        edge[after[after < len(data)]] = True
    return edge


class MergeTable:
    """Sorted pair keys of a BPE model; ``encode`` runs the merge rounds over many words at once."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        for t in spec.get("added_tokens", []):
            self.vocab[t["content"]] = t["id"]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max(self.vocab.values()) + 1)
        for t, i in self.vocab.items():
            self.tokens[i] = t
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        keys, ranks = left << 32 | right, np.arange(len(merges))
        order = np.argsort(keys, kind="stable")
        keep = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        self.keys, self.ranks = keys[order][keep], ranks[order][keep]
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        letters = byte_alphabet()
        self.first = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all words, and where each word's ids start (one more at the end)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        full = lengths > 0
        if self.suffix and full.any():
            data = np.frombuffer(b"".join(words), np.uint8)
            sym[ends[full] - 1] = self.last[data[ends[full] - 1]]
        none = np.int64(len(self.merged))
        live_sym, live_word = sym, word
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live_sym):
            rank = np.full(len(live_sym), none)
            same = live_word[1:] == live_word[:-1]
            pair = live_sym[:-1] << 32 | live_sym[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            hit = same & (self.keys[at] == pair)
            rank[:-1][hit] = self.ranks[at[hit]]
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(begin, len(live_sym)))
            best = np.repeat(np.minimum.reduceat(rank, begin), size)
            over = best == none
            if over.any():  # words without a pair leave
                done.append((live_sym[over], live_word[over]))
                live_sym, live_word, rank, best = live_sym[~over], live_word[~over], rank[~over], best[~over]
                if not len(live_sym):
                    break
            take = rank == best
            # Of overlapping occurrences (a a a) every second one merges, from the left.
            run = np.flatnonzero(take)
            new = np.concatenate([[True], np.diff(run) != 1])
            parity = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
            take[run[parity % 2 == 1]] = False
            live_sym = np.where(take, self.merged[np.where(take, best, 0)], live_sym)
            keep = np.ones(len(live_sym), bool)
            keep[1:] = ~take[:-1]
            live_sym, live_word = live_sym[keep], live_word[keep]
        sym = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        word = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.searchsorted(word[order], np.arange(len(words) + 1))


class WordCache:
    """Encodings of the words seen by this worker, for whole batches at once; it starts anew beyond ``limit`` words."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.extra: list = []

    def look_up(self, hashes: np.ndarray, word_at, note=None) -> np.ndarray:
        """The number in the cache of each hash; ``word_at(i)`` gives the bytes of the i-th word if it is new."""
        uniq, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.index) + len(uniq) > self.limit:
            self.clear()
        known = [self.index.get(h, -1) for h in uniq.tolist()]
        new = [i for i, k in enumerate(known) if k < 0]
        if new:
            found = [word_at(int(first[i])) for i in new]
            ids, at = self.encode(found)
            base = len(self.at) - 1
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            for j, i in enumerate(new):
                known[i] = base + j
                self.index[int(uniq[i])] = base + j
            if note:
                self.extra += note(found, ids, at)
        return np.array(known, np.int64)[back]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers in a row, and where each word's start (one more at the end)."""
        size = self.at[numbers + 1] - self.at[numbers]
        out = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.at[numbers] - out[:-1], size) + np.arange(out[-1])], out


class WordBpe:
    """A lower-casing BPE with word ends over letter runs, single digits and runs of other characters."""

    def __init__(self, path: str):
        self.path, self.table = path, MergeTable(path)
        self.cache = WordCache(self.table.encode)
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.specials)) + ")") if self.table.specials else None
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _known(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Each normal text's ids and its words' decodings."""
        data, offsets = code_points(texts)
        kind = classes()[data]
        starts = np.flatnonzero(word_edges(data, kind))
        ends = np.append(starts[1:], len(data))
        word = (kind[starts] <= OTHER) & (kind[starts] != SPACE)
        starts, ends = starts[word], ends[word]
        joined = GAP.join(texts)
        numbers = self.cache.look_up(
            T.span_hashes(data, starts, ends, point_hashes()),
            lambda i: joined[starts[i] : ends[i]].encode(),
            lambda found, ids, at: [" ".join(self.table.tokens[j] for j in ids[at[k] : at[k + 1]].tolist()) for k in range(len(found))],
        )
        ids, at = self.cache.gather(numbers)
        rows = np.searchsorted(starts, offsets)
        decoded = self.cache.extra
        for i in range(len(texts)):
            a, z = rows[i], rows[i + 1]
            yield ids[at[a] : at[z]], [decoded[k] for k in numbers[a:z].tolist()]

    def run(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Each text's ids and the bytes of its decoded text, in order."""
        parts = [self.special.split(t) if self.special and any(s in t for s in self.table.specials) else [t] for t in texts]
        known = [t.isascii() or not (classes()[code_points([t])[0]] == UNKNOWN).any() for t in texts]
        found = self._known([normal(p) for each, k in zip(parts, known) if k for p in each[::2]])
        for text, each, k in zip(texts, parts, known):
            if not k:
                ids = self.library.encode(text, add_special_tokens=False).ids
                yield np.array(ids, np.uint32), " ".join([self.table.tokens[i] for i in ids]).encode()
                continue
            ids, decoded = next(found)
            for special in each[1::2]:
                more = next(found)
                ids = np.concatenate([ids, np.array([self.table.vocab[special]], np.uint32), more[0]])
                decoded = [*decoded, special, *more[1]]
            yield ids, " ".join(decoded).encode()


def split_texts(texts: list[str], limit: int = T.SLICE_BYTES // 2) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > limit:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (array of int), decoded (text): the model's encoding and its decoding."""
    return _run(docs, path, id_col, text_col, digests=False)


def encode_decode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (UTF-8).  Only digests leave the task."""
    return _run(docs, path, id_col, text_col, digests=True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    if digests:
        schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    else:
        schema = f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, decoded string"

    def run(batches):
        model = WordBpe(path)
        for batch in batches:
            count, a, b = [], [], []
            for texts in split_texts([t or "" for t in batch.column(1).to_pylist()]):
                for ids, decoded in model.run(texts):
                    count.append(len(ids))
                    if digests:
                        a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                        b.append(hashlib.sha256(decoded).hexdigest())
                    else:
                        a.append(ids.astype(np.int32))
                        b.append(decoded.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(a, pa.string() if digests else pa.list_(pa.int32())), pa.array(b, pa.string())],
                names=[id_col, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
