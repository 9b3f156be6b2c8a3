"""Token ids as one compressed wavelet matrix a shard.

A wavelet matrix (Claude and Navarro, 2012) keeps a sequence as bit-planes, highest bit first; each plane holds the sequence stably
parted by the plane before. With counts of ones before each chunk it answers access, rank (how often a token occurs before a place)
and select (where its n-th occurrence is) on the planes themselves.

File: magic, 8 bytes of header length, a JSON header, then the parts that it gives offsets of: for each plane its chunks, each
deflated on its own so that a look-up inflates one chunk a plane; the ones before each chunk; ids and token counts of the documents.
A shard's documents stand in ascending id order, and shards' ranges of ids do not overlap.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.bpe_automaton import byte_letters, flat_bytes, public_path
from cuelake.llm.columns import read_table
from cuelake.llm.scratch import Scratch

MAGIC = b"WVMX0001"
#: Bits of a chunk.
CHUNK = 1 << 17
#: Text bytes of a shard, about.
SHARD_BYTES = 32 << 20
#: Fixed value: the public tokenizer's pattern, on words without white space.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Words that this pattern parts as the library does: printable ASCII but the mark of special tokens, and Latin-1 letters.
PLAIN = re.compile(r"[!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: The same by bytes of UTF-8, for words without an apostrophe: which may stand in such a word (after the byte 0xC3 the second half
#: of a Latin-1 letter), their lower case, and their class: letter, digit or other.
_PRINTED = np.array([33 <= b < 127 and chr(b) not in "<'" for b in range(256)])
_SECOND = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256)], np.uint8)
_CLASS = np.array([0 if b >= 0x80 or 97 <= b <= 122 else 1 if 48 <= b <= 57 else 2 for b in range(256)], np.uint8)
#: Text bytes whose words are looked up at a time; a longer text is taken alone.
SLICE_BYTES = 16 << 20
#: Parts, and words of other characters, that a worker remembers the ids of.
REMEMBERED = 900_000


def build(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, bits: int = 16) -> bytes:
    """The file of a shard: all its ids in order, and the id and the number of tokens of each document."""
    parts, offset, planes = [], 0, []

    def put(data: bytes) -> list[int]:
        nonlocal offset
        parts.append(data)
        offset += len(data)
        return [offset - len(data), len(data)]

    x = ids.astype(np.uint32 if bits > 16 else np.uint16)
    for level in range(bits - 1, -1, -1):
        bit = (x & x.dtype.type(1 << level)).astype(bool)
        chunks = [put(zlib.compress(np.packbits(bit[a : a + CHUNK]).tobytes(), 1)) for a in range(0, len(bit), CHUNK)]
        ones = np.cumsum([0, *(np.count_nonzero(bit[a : a + CHUNK]) for a in range(0, len(bit), CHUNK))], dtype=np.int64)
        planes.append({"chunks": chunks, "ones": put(zlib.compress(ones.astype("<i8").tobytes())), "zeros": int(len(bit) - ones[-1])})
        x = np.concatenate([_those(x, ~bit), _those(x, bit)])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    head = {
        "n": len(ids), "bits": bits, "chunk": CHUNK, "planes": planes, "rows": len(doc_ids),
        "docs": put(zlib.compress(docs.tobytes())), "known": put(zlib.compress(known.tobytes())), "counts": put(zlib.compress(counts.astype("<i8").tobytes())),
    }
    text = json.dumps(head, separators=(",", ":")).encode()
    return b"".join([MAGIC, len(text).to_bytes(8, "little"), text, *parts])


def _those(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``x[mask]``; Arrow's filter takes about half the time."""
    bits = pa.Array.from_buffers(pa.bool_(), len(x), [None, pa.py_buffer(np.packbits(mask, bitorder="little"))])
    return pa.array(x).filter(bits).to_numpy()


class WaveletMatrix:
    """A shard's file, from its bytes or any buffer of them. Look-ups inflate one chunk a plane and keep the last ones."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(self.data[8:16], "little")
        self.head = json.loads(bytes(self.data[16 : 16 + size]))
        self.base, self.n, self.bits = 16 + size, self.head["n"], self.head["bits"]
        self.ones = [self._array(p["ones"], "<i8") for p in self.head["planes"]]
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _raw(self, at: list[int]) -> bytes:
        return zlib.decompress(self.data[self.base + at[0] : self.base + at[0] + at[1]])

    def _array(self, at: list[int], kind: str) -> np.ndarray:
        return np.frombuffer(self._raw(at), kind)

    def _chunk(self, plane: int, k: int) -> np.ndarray:
        """Ones before each place of a chunk, within it, one place more than it has."""
        if (plane, k) not in self._kept:
            if len(self._kept) >= 64:
                self._kept.clear()
            size = min(CHUNK, self.n - k * CHUNK)
            bit = np.unpackbits(np.frombuffer(self._raw(self.head["planes"][plane]["chunks"][k]), np.uint8), count=size)
            self._kept[plane, k] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
        return self._kept[plane, k]

    def _ones_before(self, plane: int, i: int) -> int:
        k = i // CHUNK
        if k * CHUNK == i:
            return int(self.ones[plane][k])
        return int(self.ones[plane][k]) + int(self._chunk(plane, k)[i - k * CHUNK])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        docs, known = self._array(self.head["docs"], "<i8"), self._array(self.head["known"], np.uint8)
        return [int(d) if k else None for d, k in zip(docs, known)], self._array(self.head["counts"], "<i8")

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            one = self._ones_before(p, i + 1) - self._ones_before(p, i)
            out = out << 1 | one
            i = self.head["planes"][p]["zeros"] + self._ones_before(p, i) if one else i - self._ones_before(p, i)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for p in range(self.bits):
            a, b = self._ones_before(p, lo), self._ones_before(p, hi)
            if token >> (self.bits - 1 - p) & 1:
                lo, hi = self.head["planes"][p]["zeros"] + a, self.head["planes"][p]["zeros"] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token at places lo to hi, hi excluded."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        return self.count(token, 0, i)

    def select(self, token: int, n: int) -> int:
        """Place of the n-th occurrence of a token, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= n < hi - lo:
            raise IndexError(n)
        i = lo + n
        for p in range(self.bits - 1, -1, -1):
            zeros, one = self.head["planes"][p]["zeros"], token >> (self.bits - 1 - p) & 1
            want = i - zeros if one else i
            before = self.ones[p] if one else np.minimum(np.arange(len(self.ones[p])) * CHUNK, self.n) - self.ones[p]
            k = int(np.searchsorted(before, want, side="right")) - 1
            inside = self._chunk(p, k)
            inside = inside if one else np.arange(len(inside)) - inside
            i = k * CHUNK + int(np.searchsorted(inside, want - before[k] + 1)) - 1
        return i

    def tokens(self) -> np.ndarray:
        """All tokens, from the planes, last first: each plane says which of the low bits that are known already belong to its zeros."""
        out = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for p in range(self.bits - 1, -1, -1):
            plane = self.head["planes"][p]
            bit = np.concatenate(
                [np.unpackbits(np.frombuffer(self._raw(c), np.uint8), count=min(CHUNK, self.n - k * CHUNK)) for k, c in enumerate(plane["chunks"])] or [np.zeros(0, np.uint8)]
            ).astype(bool)
            here = np.empty_like(out)
            here[~bit] = out[: plane["zeros"]]
            here[bit] = out[plane["zeros"] :] | out.dtype.type(1 << (self.bits - 1 - p))
            out = here
        return out.astype(np.uint32)


class _Encoder:
    """Ids of whole texts by the tokenizers library, as 2-byte numbers.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its words. Each different word of some
    texts is looked at once. Words of Latin letters and ASCII are lower-cased and parted here, as the tokenizer's own pattern does, and
    the library's model is asked once for each part; the library encodes all others, and any with a special token's mark, as wholes.
    Parts, and words that are not parted by their bytes, are remembered.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_path(tokenizer))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spelt = {b: c for c, b in byte_letters().items()}
        self.words = _Remembered(self._word)
        self.parts = _Remembered(self._part)

    def __call__(self, texts: pa.Array) -> Iterator[memoryview]:
        """The ids of each text (null: none), in order."""
        texts = pc.fill_null(texts, "")
        ends, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while a < len(texts):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield from self._slice(texts.slice(a, b - a).cast(pa.string()))
            a = b

    def _slice(self, texts: pa.Array) -> Iterator[memoryview]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = lists.values.dictionary_encode()
        offsets, data = flat_bytes(self._words(found.dictionary).take(found.indices))
        at = offsets[lists.offsets.to_numpy()].tolist()
        for a, b in zip(at, at[1:]):
            yield data[a:b]

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each of these words."""
        offsets, data = flat_bytes(words)
        data = np.frombuffer(data, np.uint8)
        second = _SECOND[data[1:]] & (data[:-1] == 0xC3)
        fine = _PRINTED[data] | (data == 0xC3)
        fine[1:] |= second
        unlike = np.concatenate([[0], np.cumsum(~fine)])[offsets]
        plain = unlike[1:] == unlike[:-1]
        others = [self.words[w] for w in words.filter(pa.array(~plain)).to_pylist()]
        places = np.where(plain, np.cumsum(plain) - 1, np.count_nonzero(plain) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([self._plain(words.filter(pa.array(plain))), pa.array(others, pa.large_binary())]).take(pa.array(places))

    def _plain(self, words: pa.Array) -> pa.Array:
        """The ids of words whose bytes say where their parts are."""
        offsets, data = flat_bytes(words)
        low = _LOWER[np.frombuffer(data, np.uint8)]
        kind = _CLASS[low]
        begins = kind == 1
        begins[1:] |= kind[1:] != kind[:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        borders = np.append(starts, len(low)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(low)]).dictionary_encode()
        ids = pa.array(map(self.parts.__getitem__, parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        at, data = flat_bytes(ids)
        at = np.ascontiguousarray(at[np.searchsorted(starts, offsets)], np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(data)])

    def _word(self, w: str) -> bytes:
        if PLAIN.fullmatch(w):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(w.lower())))
        return np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u2").tobytes()

    def _part(self, x: str) -> bytes:
        spelt = x if x.isascii() else x.encode().decode("latin-1").translate(self.spelt)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}H", *ids)


class _Remembered(dict):
    """Values that a function gave, up to ``REMEMBERED``; then it forgets all. Very long words are not kept."""

    def __init__(self, fn: Callable[[str], bytes]):
        super().__init__()
        self.fn = fn

    def __missing__(self, x: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self.fn(x)
        if len(x) <= 64:
            self[x] = value
        return value


_encoders: dict[str, _Encoder] = {}


def write_shards(df: DataFrame, scratch: Scratch, shards: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 2) -> DataFrame:
    """Encode whole texts (null: empty), end each document with ``end`` and write a file a shard; (shard, path, rows, tokens).

    Documents are dealt to shards by ranges of their ids and sorted in each, null ids first; documents of one id in the order
    of their texts. A file has a name of its own for each attempt at it, and only those of the returned rows count, so a
    task that runs twice does no harm.
    """
    folder = scratch.path("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Encoder(tokenizer)
        encode, last = _encoders[tokenizer], np.array([end], "<u2").tobytes()
        docs, counts, parts = [], [], []
        for batch in batches:
            docs += batch.column(0).to_pylist()
            for got in encode(batch.column(1)):
                counts.append(len(got) // 2 + 1)
                parts += (got, last)
        if not docs:
            return
        ids = np.frombuffer(b"".join(parts), "<u2")
        del parts
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        shard = TaskContext.get().partitionId()
        path = f"{at}/shard-{shard:05d}-{uuid.uuid4().hex[:8]}.wvm"
        with store.open_output_stream(path) as out:
            out.write(build(ids, docs, np.array(counts, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([path.rsplit("/", 1)[1]]), pa.array([len(docs)]), pa.array([len(ids)])], ["shard", "file", "rows", "tokens"]
        )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sorted_rows = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    return scratch.save(sorted_rows.mapInArrow(run, "shard bigint, file string, rows bigint, tokens bigint"), "manifest")


def read_shards(manifest: DataFrame, folder: str, shards: int, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the files of a manifest. A task holds one shard at a time."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{at}/{file}") as f:
                    matrix = WaveletMatrix(f.read())
                docs, counts = matrix.documents()
                ids = matrix.tokens().astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"]
                )

    wide = placed.select("file", "start").repartition(max(1, shards), "start")  # a number of its own, so that shards are not read by one task
    return wide.mapInArrow(run, f"{id_col} {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as wavelet-matrix shards and read back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scratch = Scratch(spark, "wavelet-tokens")
    shards = max(1, -(-size // SHARD_BYTES))
    manifest = write_shards(docs, scratch, shards)
    return read_shards(manifest, scratch.path("shards"), shards)
