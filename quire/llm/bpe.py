"""Exact BPE encoding in linear time by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is the BPE encoding of a word exactly if each neighbouring pair is the encoding of its own text.
So one Aho-Corasick pass over a word notes the longest token that begins at each position; the encoder takes it from
there, checks it against the token before in the pair-compatibility table, falls back to the next shorter token, and
steps back when none is left; positions that led nowhere are not entered again.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import python_ready, table

_END = "\n"  # stands for the end-of-word suffix, so that it is one character and part of the last symbol
# Words whose encodings a worker remembers, in two generations; older ones are encoded again when met.
REMEMBERED = 150_000


def _byte_letters() -> list[str]:
    """Byte-level BPE shows bytes as letters: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in shown}
    for rank, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + rank)
    return [letters[b] for b in range(256)]


# Fixed value: the word pattern of the supported files. A contraction begins with an apostrophe, a word with a
# letter, so the order of these alternatives does not matter.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Below U+0250: letters, numbers, white space.
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\x09-\x0d\x20\x85\xa0"
_LATIN = f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+"
# Letters and numbers that Unicode 16 added, which the tokenizers library knows and Python 3.13 does not.
_LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0))
_NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Lower-case forms that Unicode 16 and 17 added, which the library knows and Python 3.13 does not: the first
# and last upper-case code point and the lower-case form of the first.
_LOWER_NEW = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
              (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B),
              (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
# Lower-casing goes character by character, without the special form of a final sigma.
_LOWER_FIRST = {0x3A3: 0x3C3} | {c: to + c - first for first, last, to in _LOWER_NEW for c in range(first, last + 1)}
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


@cache
def _class(kind: str) -> str:
    """The inside of a character class with all letters (L) or numbers (N)."""
    added = _LETTERS_16 if kind == "L" else _NUMBERS_16
    marks = bytearray(unicodedata.category(chr(i))[0] == kind for i in range(0x110000))
    for first, last in added:
        marks[first:last + 1] = b"\1" * (last + 1 - first)
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(b"\1+", marks))


class Tokenizer:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file's JSON text."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        tokens = dict(model["vocab"])
        self.letters = _byte_letters()
        # Special tokens are found in the raw text, before anything is normalised.
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != _PATTERN:
            raise ValueError("only the word pattern of these files is supported")
        if spec["normalizer"]["normalizers"] != _NORMALIZER:
            raise ValueError("only the normalizer of these files is supported")
        letters, numbers = _class("L"), _class("N")
        self._words = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{_SPACES}{letters}{numbers}]+")
        # The same for lower-cased texts of Latin letters only, with plain classes and the common case first.
        self._latin = re.compile(_LATIN)

        def inner(token: str) -> str:
            return token[:-len(suffix)] + _END if token.endswith(suffix) else token

        self.text_of: dict[int, str] = {i: t for t, i in tokens.items()} | {i: t for t, i in self.special.items()}
        self._inner = {i: inner(t) for t, i in tokens.items()}
        self._ids = {t: i for i, t in self._inner.items()}
        self._rank = {tuple(map(inner, pair)): r for r, pair in enumerate(
            p if isinstance(p, list) else p.split(" ") for p in model["merges"])}
        self._matches = ahocorasick.Automaton()
        self._shorter: dict[int, int] = {}
        for t, i in self._ids.items():
            self._matches.add_word(t, i)
            self._shorter[i] = next((self._ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self._ids), -1)
        self._matches.make_automaton()
        self._length = {i: len(t) for i, t in self._inner.items()}
        self._pairs: dict[int, bool] = {}

        # Decoding: all token texts in one string, and where each begins.
        size = max(self.text_of) + 1
        self.blob = "".join(self.text_of.get(i, "") for i in range(size))
        self.offsets = array("q", [0])
        for i in range(size):
            self.offsets.append(self.offsets[-1] + len(self.text_of.get(i, "")))

    def _merged(self, text: str) -> list[str]:
        """Plain merging of a short text, lowest rank first: fills the pair table."""
        parts = list(text)
        if parts[-1] == _END:
            parts[-2:] = ["".join(parts[-2:])]
        while len(parts) > 1:
            rank, at = min((self._rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _check(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their joined text; remembered in the pair table."""
        a, b = self._inner[left], self._inner[right]
        if len(self._pairs) > 400_000:
            self._pairs.clear()
        known = self._pairs[left << 32 | right] = a[-1] != _END and self._merged(a + b) == [a, b]
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte letters, its end included."""
        text = word + _END
        size, shorter, length, pairs = len(text), self._shorter, self._length, self._pairs
        # Matches come by their ends, so that of those with one beginning the longest is noted last.
        longest = [-1] * size
        for end, token in self._matches.iter(text):
            longest[end + 1 - length[token]] = token
        taken: list[int] = []
        dead: set[int] = set()
        at, fresh, token = 0, True, -1
        while at < size:
            if fresh:
                token = longest[at]
            while token != -1:
                if at + length[token] not in dead:
                    if not taken:
                        break
                    known = pairs.get(taken[-1] << 32 | token)
                    if known or known is None and self._check(taken[-1], token):
                        break
                token = shorter[token]
            if token != -1:
                taken.append(token)
                at += length[token]
                fresh = True
            else:
                dead.add(at)
                if not taken:
                    raise ValueError(f"no token sequence for {word!r}")
                last = taken.pop()
                at -= length[last]
                token, fresh = shorter[last], False
        return taken

    def words(self, text: str) -> list[str]:
        """The words that are encoded on their own; white space goes."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(_LOWER_FIRST)
        text = text.lower()
        if not _BEYOND_LATIN.search(text):
            return self._latin.findall(text)
        return self._words.findall(text)

    def parts(self, text: str):
        """Stretches of ordinary text and special tokens, in order: ``(text, None)`` and ``(None, id)``."""
        if self._special is None or "<|" not in text:
            yield text, None
            return
        at = 0
        for match in self._special.finditer(text):
            yield text[at:match.start()], None
            yield None, self.special[match[0]]
            at = match.end()
        yield text[at:], None

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for stretch, special in self.parts(text):
            if special is not None:
                ids.append(special)
                continue
            for word in self.words(stretch):
                ids += self.encode_word("".join([self.letters[b] for b in word.encode()]))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The texts of the ids, joined by blanks, as a file without a decoder has it; unknown ids are left out."""
        blob, offsets, known = self.blob, self.offsets, self.text_of
        return " ".join([blob[offsets[i]:offsets[i + 1]] for i in ids if i in known])


class _Memory(dict):
    """Encodings of words as ready texts of ids and of decoded tokens."""

    def __init__(self, tokenizer: Tokenizer, most: int = REMEMBERED):
        super().__init__()
        self.tokenizer, self.most, self.old = tokenizer, most, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.old.get(word)
        if found is None:
            t = self.tokenizer
            ids = t.encode_word(word if word.isascii() and word.isprintable() else "".join(
                [t.letters[b] for b in word.encode()]))
            found = " ".join(map(str, ids)), t.decode(ids)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def _digests(text: str, memory: _Memory) -> tuple[int, str, str]:
    tokenizer = memory.tokenizer
    ids, decoded = [], []
    for stretch, special in tokenizer.parts(text):
        if special is not None:
            ids.append(str(special))
            decoded.append(tokenizer.decode([special]))
            continue
        found = list(map(memory.__getitem__, tokenizer.words(stretch)))
        if found:
            ids.append(" ".join([x[0] for x in found]))
            decoded.append(" ".join([x[1] for x in found]))
    joined = " ".join(ids)
    count = joined.count(" ") + 1 if joined else 0
    return count, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()


_LOADED: dict[str, _Memory] = {}


def _memory(definition: str) -> _Memory:
    """One tokenizer a worker process: building its automaton takes longer than a small batch."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Memory(Tokenizer(definition))
    return _LOADED[key]


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                     carry_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded``).

    Each whole text is encoded as the tokenizer file at ``path`` says and decoded again. Null and empty texts have no
    tokens and decode to the empty text; null ids stay null; repeated rows each give a row; an empty table gives none;
    other columns of the input are not looked at. The file (at most a few MB) is read on the driver and broadcast.
    """
    spark = python_ready(docs)
    definition = spark.sparkContext.broadcast(_definition(path))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))

    def digests(batches):
        memory = _memory(definition.value)
        for batch in batches:
            out = [_digests(t or "", memory) for t in batch.column("body").to_pylist()]
            counts, ids, decoded = zip(*out) if out else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                       pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if carry_ids:
                tokenizer = memory.tokenizer
                lists = [tokenizer.encode(t or "") for t in batch.column("body").to_pylist()]
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(map(tokenizer.decode, lists), pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(digests, schema + (", ids array<int>, decoded string" if carry_ids else ""))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())
