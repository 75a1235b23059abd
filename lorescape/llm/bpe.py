"""Byte-pair encoding and decoding with a published vocabulary.

A word's symbols form a doubly linked list; a heap holds the ranks of mergeable neighbours. The lowest rank is merged
first, and entries whose neighbours have changed meanwhile are skipped as stale. Decoding concatenates vocabulary strings.

Which code points are letters, numbers and capitals depends on the version of Unicode, and the tokenizers library, Python and the regex
module each have their own. Only for code points that Python doesn't know yet the library is asked, once a process, what they are;
normalizing, splitting, merging and decoding are done here.

Defined cases: a null or empty text has no ids and decodes to the empty string. Words have no length limit: one of n
letters costs n log n. Repeated rows are encoded each by itself, an empty table gives an empty table, and only the two
named columns of the input are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from lorescape.llm.shared import per_text

#: Words of a generation that a worker remembers. A full one becomes the old one, whose words move on when they are used again.
CACHE_WORDS = 100_000
#: Longer words are not remembered.
CACHE_CHARS = 48

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Python's split() takes these four for white space; Unicode doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = {}, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


def ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


@lru_cache(maxsize=1)
def unicode_differences() -> tuple[dict[str, str], dict[str, str]]:
    """Where the library has other Unicode data than Python's and regex's: by class what regex wrongly puts in, and lower-case letters.

    Only code points without a name in Python can differ; of those the library is asked about the ones that regex calls letters
    or numbers.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    wrong = {}
    for kind in (r"\p{L}", r"\p{N}"):
        asked = regex.findall(kind, unknown)
        split = pre_tokenizers.Split(Regex(kind), "removed")
        left = "".join(part for part, _ in split.pre_tokenize_str("".join("!" + c for c in asked)))
        if rest := sorted(ord(c) for c in left if c != "!"):
            wrong[kind] = ranges(rest)
    lower = normalizers.Lowercase()
    found = {c: lower.normalize_str(c) for c in regex.findall(r"\p{Lu}", unknown)}
    return wrong, {c: x for c, x in found.items() if x != c.lower()}


class Remembered:
    """The ids of words seen lately: two generations of at most CACHE_WORDS, so frequent words stay and memory is bounded."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        found = self.young.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.put(word, found)
        return found

    def put(self, word: str, ids: bytes) -> None:
        if len(word) <= CACHE_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = ids


class WordBpe:
    """A tokenizer of the kind "BPE with word ends": lower case, white space dropped, a suffix marks a word's last symbol."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path} isn't a lower-casing BPE vocabulary with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        wrong, self.lower = unicode_differences()
        for kind, points in wrong.items():
            pattern = pattern.replace(kind, f"[{kind}--[{points}]]")
        self.other_pieces = regex.compile(pattern, regex.V1)
        self.letters = byte_letters()
        strings = {i: s for s, i in {**self.ids, **self.special}.items()}
        self.strings = np.array([strings.get(i, "").encode() for i in range(max(strings) + 1)], dtype=object)
        self.known, self.known_pieces = Remembered(), Remembered()

    def merged(self, ids: list[int]) -> list[int]:
        """Applies the merges in the order of their ranks, leftmost first among equals."""
        n, found = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], k, m[1]) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if (m := found(pair))]
        heapq.heapify(heap)
        while heap:
            _, left, made = heapq.heappop(heap)
            right = after[left]
            if ids[left] < 0 or right < 0 or (m := found((ids[left], ids[right]))) is None or m[1] != made:
                continue  # stale: one of the two has been merged with something else
            ids[left], ids[right] = made, -1
            follower = after[left] = after[right]
            if follower >= 0:
                before[follower] = left
                if m := found((made, ids[follower])):
                    heapq.heappush(heap, (m[0], left, m[1]))
            leader = before[left]
            if leader >= 0 and (m := found((ids[leader], made))):
                heapq.heappush(heap, (m[0], leader, m[1]))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        found = self.known_pieces.get(piece)
        if found is None:
            symbols = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            ids = self.merged([i for s in symbols if (i := self.ids.get(s)) is not None])
            found = struct.pack(f"<{len(ids)}I", *ids)
            self.known_pieces.put(piece, found)
        return found

    def word(self, word: str) -> bytes:
        """The ids of a stretch without white space, packed likewise."""
        found = self.known.get(word)
        if found is None:
            if word.isascii():
                pieces = self.pieces.findall(word.lower())
            else:  # letter by letter: no final sigma
                pieces = self.other_pieces.findall("".join(self.lower.get(c) or c.lower() for c in unicodedata.normalize("NFC", word)))
            found = b"".join([self.piece(p) for p in pieces])
            self.known.put(word, found)
        return found

    def plain(self, text: str) -> bytes:
        words = [w for w in WHITE.split(text) if w] if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.word, words))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed as word() does it; the added tokens in a text are found before anything else."""
        if not self.special_at or "<|" not in text:
            return self.plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the vocabulary strings joined by one space, as is usual for a vocabulary without a decoder."""
        return b" ".join(self.strings[np.frombuffer(ids, dtype="<u4")].tolist())


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its id, n_tokens, and SHA-256 of its packed ids and of its decoded text."""

    def make():
        bpe = load(vocabulary)

        def work(keys: list, texts: list[str]) -> dict:
            ids = [bpe.encode(t) for t in texts]
            return {
                "doc_id": keys,
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }

        return work

    return per_text(docs, SCHEMA, make, key, text)


def token_ids(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its id and the array of its token ids."""

    def make():
        bpe = load(vocabulary)
        return lambda keys, texts: {"doc_id": keys, "ids": [np.frombuffer(bpe.encode(t), dtype="<u4").astype(np.int32) for t in texts]}

    return per_text(docs, "doc_id long, ids array<int>", make, key, text)


def decode_ids(rows: DataFrame, vocabulary: str) -> DataFrame:
    """The inverse of token_ids(): doc_id and the decoded text; null ids give a null text."""
    import pyarrow as pa

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.array(x, dtype="<u4").tobytes()).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")
