"""Exact token counts at every prefix of a text, by dynamic programming over the prefixes.

A byte-level BPE encoding is characterised by its neighbours: a sequence of tokens is the encoding of its
bytes if and only if each two adjacent tokens are the encoding of their own bytes. So the last token of the
encoding of a prefix is the one token that ends there and goes with the last token before it, and one pass over
the prefixes of a word (a piece of the splitting pattern) gives the count at each: count[i] = count[i - len] + 1.
Counts of words add up to counts of texts, so truncation and budget questions need no further encoding.

Defined results: a null or empty text has 0 tokens. Special strings in a text count as the library counts them by
default: as one token. Repeated rows each get a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, map_texts

LIMIT = 512
#: Entries of each of a worker's memos of words and of pairs of tokens; a full memo is emptied.
MEMO = 1_000_000
#: The end of the splitting pattern that looks ahead: of white space before a word, the last character goes with the word.
AHEAD = r"|\s+(?!\S)|\s+"
#: White space (White_Space of Unicode) beyond ASCII.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.tokens, special_tokens=self.special)
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.longest = max(map(len, self.tokens))
        # without its look-ahead the pattern is matched by an automaton, in some two thirds of the time
        plain = public_tokenizers.PATTERN.removesuffix(AHEAD) + r"|\s+"
        usable = public_tokenizers.PATTERN.endswith(AHEAD) and not any(c.isspace() for t in self.special for c in t)
        self.plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=self.tokens, special_tokens=self.special) if usable else None

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a text as the library gives them by default."""
        parts = self.cut(text)
        if parts is None:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        found = [self.plain.encode_to_numpy(t, disallowed_special=()) for t in parts]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def cut(self, text: str) -> list[str] | None:
        """The text in parts that split alike without looking ahead: cut before the last character of each white space of several before a word.

        None where that isn't sure: with special strings, as the text before one ends there, and with white space beyond ASCII.
        """
        if self.plain is None or any(t in text for t in self.special):
            return None
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not text.isascii() and ((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3)).any() and _WIDE_SPACE.search(text):
            return None
        low = data <= 32
        if not (low[:-1] & low[1:]).any():
            return [text]
        space = ~NOT_SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 255)]
        at = np.flatnonzero(space[:-2] & space[1:-1] & ~space[2:]) + 1
        if not len(at):
            return [text]
        at = [0, *at.tolist(), len(text)]
        return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class PrefixCounter:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.by_id = {i: t for t, i in vocabulary.tokens.items()}
        self.pairs: dict[int, bool] = {}
        self.totals: dict[str, int] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens are the encoding of their own bytes."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self.v.encoding._core_bpe.encode_single_piece(self.by_id[left] + self.by_id[right]) == [left, right]
        return known

    def word(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of a word, by bytes, from 0."""
        get, pair, most = self.v.tokens.get, self.pairs.get, self.v.longest
        last, count = [-1], [0]
        for i in range(1, len(piece) + 1):
            for j in range(i - most if i > most else 0, i):
                token = get(piece[j:i])
                if token is not None:
                    if j:
                        known = pair(last[j] << 20 | token)
                        if known is None:
                            known = self.fits(last[j], token)
                        if not known:
                            continue
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        return count

    def total(self, word: str) -> int:
        """Tokens of a whole word."""
        n = self.totals.get(word)
        if n is None:
            if len(self.totals) >= MEMO:
                self.totals.clear()
            n = self.totals[word] = self.word(word.encode())[-1]
        return n

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those."""
        at = 0
        for m in self.v.specials.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of a text: the count at its last prefix."""
        memo, find = self.totals, self.v.words.findall
        total = 0
        for part, special in self.parts(text) if self.v.specials.search(text) else ((text, False),):
            if special:
                total += 1
                continue
            for w in find(part):
                n = memo.get(w)
                total += self.total(w) if n is None else n
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:k] for each k from 0 to len(text)."""
        out, before, at = np.zeros(len(text) + 1, np.int64), 0, 0
        open_part, open_before = 0, 0  # where the part after the last special string begins
        run = None  # place and count of a prefix that ends in the last white space before a word
        for part, special in self.parts(text):
            if special:
                # strictly inside, the special string is ordinary text and joins what is before it
                for k in range(1, len(part)):
                    out[at + k] = open_before + self.count(text[open_part : at + k])
                at += len(part)
                before += 1
                out[at] = before
                open_part, open_before = at, before
                continue
            for m in self.v.words.finditer(part):
                w = m[0]
                bytewise, size = self.word(w.encode()), 0
                counts = []
                for c in w:
                    size += len(c.encode())
                    counts.append(bytewise[size])
                if w[0] == "'" and len(w) == 3 and w[1:] in ("re", "ve", "ll"):  # cut before its end, it is two words
                    counts[1] = self.total(w[0]) + self.total(w[1])
                out[at + 1 : at + len(w) + 1] = before + np.array(counts)
                at += len(w)
                if run is not None:
                    out[run[0]] = run[1]
                    run = None
                follow = part[m.end() : m.end() + 1]
                if w.isspace() and follow.isspace():
                    # the prefix that ends in that white space has the whole run as one word
                    run = at + 1, before + self.word((w + follow).encode())[-1]
                before += bytewise[-1]
        return out

    def truncate(self, text: str, budget: int) -> int:
        """The most characters from the start that take at most `budget` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


_VOCABULARIES: dict[str, Vocabulary] = {}
_COUNTERS: dict[str, PrefixCounter] = {}


def vocabulary_for(path: str) -> Vocabulary:
    """The vocabulary of this Python process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def counter_for(path: str) -> PrefixCounter:
    """The counter of this Python process; its memos serve task after task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(vocabulary_for(path))
    return _COUNTERS[path]


def count_tokens(documents: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    path = tokenizer or default_path()

    def make():
        counter = counter_for(path)

        def work(texts: list[bytes], _rows: pa.RecordBatch) -> dict:
            return {"n_bytes": np.array([len(t) for t in texts], np.int64), "n_tokens": np.array([counter.count(t.decode()) for t in texts], np.int64)}

        return work

    return map_texts(documents, make, "n_bytes long, n_tokens long", ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the array of token counts at every prefix of the text, from 0 characters on."""
    path = tokenizer or default_path()

    def make():
        counter = counter_for(path)
        return lambda texts, _rows: {"counts": pa.array([counter.prefixes(t.decode()) for t in texts], pa.list_(pa.int64()))}

    return map_texts(documents, make, "counts array<long>", ["doc_id"])


def truncate(documents: DataFrame, budget: int, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the longest prefix of each text that takes at most `budget` tokens."""
    path = tokenizer or default_path()

    def make():
        counter = counter_for(path)
        return lambda texts, _rows: {"prefix": pa.array([t.decode()[: counter.truncate(t.decode(), budget)] for t in texts], pa.string())}

    return map_texts(documents, make, "prefix string", ["doc_id"])
