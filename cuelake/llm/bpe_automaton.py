"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton's arcs are labelled with tokens and its paths are exactly the tokenizations that the merges give. It starts as one
state with a loop for each byte. Each merge (u, v) of a token w, in order, is one gadget: the state after u loses its arc v, every
state with an arc u gets an arc w, and w leads to a copy of the state after v as it was. States are kept as versions of the states
that they were copied from (``born``, ``left``, ``right``, ``cut``), so 50,000 gadgets take a few tables of that size; whether a state has
an arc follows from them in a few steps, and each answer goes into the table of transitions.

A word's bytes are read once from left to right. At each place exactly one token ends the path that reaches it: of the vocabulary's
tokens that the bytes before end with, longest first, the one that the state before it has an arc of. It follows from the bytes up to
there alone, so new words are read in sorted order and each begins where it parts from the word before. Decoding joins the labels of
the ids' arcs.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Collection, Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.columns import read_table

#: Fixed value: the public byte-level pre-split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers; beyond, it forgets all and starts again, and then also its transitions if there are as many.
REMEMBERED = 400_000
#: Text bytes whose new words are sorted together; a longer text is taken alone.
SLICE_BYTES = 1 << 20


@cache
def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


def flat_bytes(x: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The offsets of an array's strings, and the bytes that they are of, both from 0 on."""
    wide = pa.types.is_large_binary(x.type) or pa.types.is_large_string(x.type)
    if not len(x):
        return np.zeros(1, np.int64), memoryview(b"")
    offsets = np.frombuffer(x.buffers()[1], np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1]
    data = memoryview(x.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    return offsets - offsets[0], data


class Automaton:
    """Compiled from a tokenizer's vocabulary and merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        spell = lambda t: bytes(letters[c] for c in t)
        self.labels: dict[int, bytes] = {i: spell(t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.labels |= {i: t.encode() for t, i in special.items()}
        self.born = {i: -1 for i, x in self.labels.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(merges):  # one gadget each
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.left or (u, v) in self.cut:
                raise ValueError(f"merge {n} makes a token that an earlier merge makes")
            if self.born[u] >= n or self.born[v] >= n:
                raise ValueError(f"merge {n} uses a token that is not made yet")
            self.left[w], self.right[w], self.born[w], self.cut[u, v] = u, v, n, n
        reachable = {i for i, x in self.labels.items() if len(x) == 1 or i in self.left}
        self.tokens = {self.labels[i]: i for i in reachable}
        self.ahead = {x[:k] for x in self.tokens for k in range(1, len(x) + 1)}  # prefixes of tokens
        self.steps: dict[bytes, tuple[bytes, tuple[tuple[int, int], ...]]] = {}
        self.table = pa.array([self.labels.get(i) for i in range(max(self.labels) + 1)], pa.large_binary())
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        self.transitions: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    def has_arc(self, u: int, v: int) -> bool:
        """Does the state after token u have an arc v? From the gadgets, latest first."""
        before = len(self.cut) + 1
        born, cut, left, right = self.born, self.cut, self.left, self.right
        while True:
            if cut.get((u, v), before) < before:
                return False
            at_u, at_v = born[u], born[v]
            if at_u < 0 and at_v < 0:
                return True
            if at_v >= at_u:  # the arc was added where there was one of v's left part, which this gadget had cut already
                v, before = left[v], at_v + 1
            else:  # the state is a copy of the one after u's right part as it was then
                u, before = right[u], at_u

    def encode_words(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of pre-split words; what a word shares with the one before is read once."""
        steps, transitions, before = self.steps, self.transitions, b""
        read, last, start = [b""], [-1], [0]  # by place: the bytes before it that may begin a token, the token that ends there, where it starts
        for word in words:
            n, same = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del read[same + 1 :], last[same + 1 :], start[same + 1 :]
            for k in range(same + 1, n + 1):
                ahead = read[-1] + word[k - 1 : k]
                step = steps.get(ahead)
                if step is None:
                    step = steps[ahead] = self._step(ahead)
                read.append(step[0])
                for size, v in step[1]:
                    j = k - size
                    if not j:
                        break
                    u = last[j]
                    if u < 0:
                        continue
                    arc = transitions.get((u, v))
                    if arc is None:
                        arc = transitions[u, v] = self.has_arc(u, v)
                    if arc:
                        break
                else:
                    j, v = 0, -1
                last.append(v)
                start.append(j)
            out, k = [], n
            while k > 0:
                out.append(last[k])
                k = start[k]
            yield out[::-1]
            before = word

    def _step(self, read: bytes) -> tuple[bytes, tuple[tuple[int, int], ...]]:
        """The longest end of these bytes that a token begins with, and the tokens that it ends with, by length, longest first."""
        while read and read not in self.ahead:
            read = read[1:]
        ends = ((len(read) - k, self.tokens.get(read[k:])) for k in range(len(read)))
        return read, tuple((size, v) for size, v in ends if v is not None)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        return next(self.encode_words([word]))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, each as 4 bytes, little end first."""
        if self.split is None or not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        out = []
        for k, part in enumerate(self.split.split(text)):
            out.append(self.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(self.words.__getitem__, self.pattern.findall(part))))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of whole texts, as ``encode`` gives them; their new words are encoded together."""
        split = [None if self.split is not None and any(s in t for s in self.special) else self.pattern.findall(t) for t in texts]
        found = pa.array([w for words in split if words for w in words], pa.string()).dictionary_encode()
        different = found.dictionary.to_pylist()
        self.words.learn([w for w in different if w not in self.words])
        offsets, data = flat_bytes(pa.array(map(self.words.__getitem__, different), pa.large_binary()).take(found.indices))
        a = 0
        for text, words in zip(texts, split):
            if words is None:
                yield self.encode(text)
            else:
                b = a + len(words)
                yield bytes(data[offsets[a] : offsets[b]])
                a = b

    def decode(self, ids: np.ndarray) -> str:
        """The arc labels of the ids, as text; bytes that are no text become U+FFFD."""
        if len(ids) and ids.max() >= len(self.table):
            raise KeyError(int(ids.max()))
        found = self.table.take(pa.array(ids))
        if found.null_count:
            raise KeyError("an id that is no token")
        return bytes(flat_bytes(found)[1]).decode("utf-8", "replace")


class _Words(dict):
    """Ids of words that were met, bounded."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def learn(self, words: Collection[str]) -> None:
        """Take in words that are not here yet, as far as there is room; others are made when they are asked for."""
        if len(self) + len(words) > REMEMBERED:
            self._forget()
        fresh = sorted(islice((w for w in words if len(w) <= 64), REMEMBERED))
        for word, ids in zip(fresh, self.automaton.encode_words(map(str.encode, fresh))):
            self[word] = struct.pack(f"<{len(ids)}I", *ids)

    def _forget(self) -> None:
        self.clear()
        for table in (self.automaton.transitions, self.automaton.steps):
            if len(table) >= REMEMBERED:
                table.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.encode_word(word.encode())
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= REMEMBERED:
            self._forget()
        if len(word) <= 64:
            self[word] = found
        return found


@cache
def load(path: str) -> Automaton:
    """The automaton of a tokenizer file; compiled once in a worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` of ``df`` and n_tokens, ids (binary, 4 bytes each, little end first; if wanted), ids_sha256, decoded_sha256.

    Whole texts; null counts as empty: no ids, and hashes of nothing. A special token's string is that token. ``tokenizer`` names a
    file of the public tokenizers, which every worker reads from its own installation. The ids are decoded again in the same pass.
    """
    fields = [df.schema[c] for c in keep]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "n_tokens bigint, " + "ids binary, " * with_ids
    schema += "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(public_path(tokenizer))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(keep))), 0)
            ends, a = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while a < batch.num_rows:
                b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, side="right"))
                part = batch.slice(a, max(1, b - a))
                a += part.num_rows
                n, ids, one, two = [], [], [], []
                for got in automaton.encode_all([x or "" for x in part.column(len(keep)).to_pylist()]):
                    n.append(len(got) // 4)
                    one.append(hashlib.sha256(got).hexdigest())
                    two.append(hashlib.sha256(automaton.decode(np.frombuffer(got, "<u4")).encode()).hexdigest())
                    if with_ids:
                        ids.append(got)
                more = [pa.array(n, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else []), pa.array(one), pa.array(two)]
                names = [*keep, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *more], names)

    return df.select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = (), tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Columns ``keep`` of ``df`` and the text of its ``ids`` as ``encode`` gives them; null ids give an empty text."""
    schema = "".join(f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(public_path(tokenizer))
        for batch in batches:
            texts = [automaton.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*[F.col(c) for c in keep], F.col(ids).alias("_ids")).mapInArrow(run, schema)


def op6_token_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    return encode(read_table(spark, sf_dir, "documents"), keep=("doc_id",), with_ids=False)
