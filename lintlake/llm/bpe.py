"""Byte-level BPE, encoding and decoding, by a walk over the trie of a batch's distinct words.

A prefix of a word has one valid last token: the token that ends there and that no merge joins, across the seam, with the last
token of what stands before it. So a node of the trie needs one number, its last token, and finds it from its ancestors' numbers;
prefixes that words share are settled once. The trie is held as the sorted words with the lengths of their common prefixes: going
through them in order is the depth-first walk, and only the states on the current path exist. A word's ids are read off by going
back from its node, a token at a time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import sliced_by_bytes, texts_of

NEVER = 1 << 60
WORDS_KEPT = 200_000
SEAMS_KEPT = 2_000_000
#: Characters whose classes are the same in every Unicode version; texts of others take the library's own word splitter.
PLAIN = ((0, 0x4FF), (0x2010, 0x2027), (0x2030, 0x205E), (0x4E00, 0x9FA5))


def _class(letter: str) -> str:
    """The plain characters of a general category, as the inside of a bracket expression."""
    points = {c for low, high in PLAIN for c in range(low, high + 1) if unicodedata.category(chr(c))[0] == letter}
    lows, highs = sorted(c for c in points if c - 1 not in points), sorted(c for c in points if c + 1 not in points)
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in zip(lows, highs, strict=True))


@cache
def plain_patterns() -> tuple[re.Pattern, re.Pattern]:
    """A pattern of what is not plain, and the vocabulary's word pattern with its classes spelt out for plain characters."""
    plain = "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in PLAIN)
    space, letters, numbers = r" \t\n\x0b\x0c\r\x85\xa0", _class("L"), _class("N")
    # Fixed value: the pattern that cuts texts into words.
    words = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(f"[^{plain}]"), re.compile(words)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as lines:
            parts = json.load(lines)
        byte_of = byte_alphabet()
        named = parts["model"]["vocab"]
        self.ids = {bytes(byte_of[c] for c in token): number for token, number in named.items()}
        self.bytes_of = {number: token for token, number in self.ids.items()}
        self.ranks: dict[int, dict[int, int]] = {}  # by the left token, then the right one
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(parts["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = named[left], named[right]
            self.ranks.setdefault(key[0], {})[key[1]] = rank
            self.halves.setdefault(named[left + right], (*key, rank))
        self.heads = {token[:at] for token in self.ids for at in range(len(token) + 1)}
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.bytes_of |= {number: text.encode() for text, number in self.added.items()}
        self.size_of = {number: len(token) for number, token in self.bytes_of.items()}
        # All tokens' bytes in one row, by id; the last place is that of numbers without a token, which have none.
        tokens = [self.bytes_of.get(number, b"") for number in range(max(self.bytes_of) + 2)]
        self._blob, self._sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._strange, self._words = plain_patterns()
        self._slow_words = Tokenizer.from_file(path).pre_tokenizer
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._seams: dict[int, bool] = {}
        # States of the scanner: the longest end of what was read that begins a token, made when first reached.
        self._state_of, self._text_of, self._ending, self._next = {b"": 0}, [b""], [()], {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end (0 left, 1 right) while a token is put together, each with the rank that ends it."""
        key = token, side
        if key not in self._spines:
            out, ends = [], NEVER
            while True:
                out.append((token, ends))
                if token not in self.halves:
                    break
                token, ends = self.halves[token][side], self.halves[token][2]
            self._spines[key] = out
        return self._spines[key]

    def parted(self, left: int, right: int) -> bool:
        """Whether BPE over the two tokens' bytes leaves them as they are: no merge joins what stands on both sides of the seam.

        A merge over the seam happens if both its tokens still stand at its rank; of equal ranks the leftmost pair goes first.
        """
        answer, ranks, rights = True, self.ranks, self.spine(right, 0)
        for a, a_ends in self.spine(left, 1):
            row = ranks.get(a)
            if row is not None:
                for b, b_ends in rights:
                    rank = row.get(b)
                    if rank is not None and rank < a_ends and rank <= b_ends:
                        answer = False
        if len(self._seams) >= SEAMS_KEPT:
            self._seams.clear()
        self._seams[left << 32 | right] = answer
        return answer

    def _step(self, state: int, byte: int) -> int:
        """The scanner's next state; a state knows the tokens that end there, the longest first, with their sizes."""
        text = self._text_of[state] + bytes([byte])
        while text not in self.heads:
            text = text[1:]
        if text not in self._state_of:
            self._state_of[text] = len(self._text_of)
            self._text_of.append(text)
            ends = [text[at:] for at in range(len(text))]
            self._ending.append(tuple((len(end), self.ids[end]) for end in ends if end in self.ids))
        self._next[state << 8 | byte] = self._state_of[text]
        return self._state_of[text]

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Ids of distinct words, in depth-first order of their trie. Empty words have none."""
        path, last, states = b"", [0], [0]  # at each depth of the path: its last token, and the scanner's state
        step, seam, ending, size_of = self._next.get, self._seams.get, self._ending, self.size_of
        push, push_state = last.append, states.append
        for word in sorted(words):
            shared, most = 0, min(len(word), len(path))
            while shared + 64 <= most and word[shared:shared + 64] == path[shared:shared + 64]:
                shared += 64
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del last[shared + 1:], states[shared + 1:]
            state = states[-1]
            for end, byte in enumerate(word[shared:], shared + 1):
                state = step(state << 8 | byte) or self._step(state, byte)
                push_state(state)
                for size, token in ending[state]:
                    if size == end:
                        push(token)
                        break
                    left = last[end - size]
                    fits = seam(left << 32 | token)
                    if fits or fits is None and self.parted(left, token):
                        push(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path, found, at = word, [], len(word)
            while at:
                token = last[at]
                found.append(token)
                at -= size_of[token]
            found.reverse()
            yield word, found

    def words(self, text: str) -> list[str]:
        if not self._strange.search(text):
            return self._words.findall(text)
        return [text[start:end] for _, (start, end) in self._slow_words.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        """The text between added tokens, and these by their ids."""
        at = 0
        for found in self._split.finditer(text) if self._split else ():
            yield None, text[at:found.start()]
            yield self.added[found[0]], ""
            at = found.end()
        yield None, text[at:]

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of distinct words. New ones go through one trie; those met lately are kept, up to twice a number."""
        out, new = {}, {}
        for word in words:
            ids = self._young.get(word)
            if ids is None:
                ids = self._old.get(word)
                if ids is None:
                    new[word.encode()] = word
                    continue
                self._young[word] = ids
            out[word] = ids
        for word, found in self.walk(new):
            word = new[word]
            out[word] = self._young[word] = array("i", found).tobytes()
        if len(self._young) > WORDS_KEPT:
            self._young, self._old = {}, self._young
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the words of all of them are looked up together."""
        cut = [[(token, self.words(part)) for token, part in self.parts(text)] for text in texts]
        of = self.ids_of(set(chain.from_iterable(words for parts in cut for _, words in parts))).__getitem__
        return [np.frombuffer(b"".join(
            b"".join(map(of, words)) if token is None else array("i", [token]).tobytes() for token, words in parts), np.int32) for parts in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, and ids that name no token nothing."""
        of = self.bytes_of
        try:
            return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return b"".join([of.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def decode_batch(self, lists: pa.ListArray) -> list[str]:
        """Text of each list of ids; the bytes of all of them are gathered together."""
        ids, none = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(), len(self._sizes) - 1
        ids = np.where((ids < 0) | (ids > none), none, ids)
        sizes = self._sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        gathered = self._blob[np.repeat(self._starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        lengths = lists.value_lengths().fill_null(0).to_numpy()
        cuts = ends[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)].tolist()
        return [gathered[start:end].decode("utf-8", "replace") for start, end in zip(cuts, cuts[1:])]


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary_file(name: str = "byte_bpe_50k") -> str:
    """Place of a vocabulary's JSON file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def _carried(df: DataFrame, without: set[str]) -> list[str]:
    return [c for c in df.columns if c not in without]


def encode_documents(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds the BPE ids of a text column as array<int>; no row is moved. Texts that hold an added token's string get its id.

    Null and empty texts have no ids, a text of any length is encoded whole, rows with equal or null keys stay apart, an empty
    table gives none. A column that already has the name of the result is replaced; all others are carried along. The text is
    left out of the result: ``decode_documents`` gives it back.
    """
    keep = _carried(docs, {text, ids})
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_bpe_text"))
    schema = source.drop("_bpe_text").withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path or vocabulary_file())
        for batch in sliced_by_bytes(batches, "_bpe_text"):
            found = vocabulary.encode_batch(texts_of(batch, "_bpe_text"))
            ends = np.cumsum([0, *map(len, found)])
            values = np.concatenate([np.empty(0, np.int32), *found])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], column], names=[*keep, ids])

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text of an id column, special tokens included. Null ids, inside or as a whole, give no bytes."""
    keep = _carried(encoded, {text})
    schema = encoded.select(*[F.col(f"`{c}`") for c in keep]).withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path or vocabulary_file())
        for batch in sliced_by_bytes(batches, ids):
            texts = vocabulary.decode_batch(batch.column(ids))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, text])

    return encoded.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
