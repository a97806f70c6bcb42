"""Token ids in binary blocks whose document boundaries are Elias-Fano coded.

File format, version 2, all integers little-endian. A file of blocks is a Parquet table in the
store that Spark writes to; each row's `blob` is one block, complete in itself:

    magic "EFTK", version u16, bytes per id u16, documents u32, documents without doc_id u32,
    ids u64, least doc_id i64, boundaries, doc_ids, ids

Boundaries and doc_ids (less the least one) are ascending integers, coded as in Elias (1974) and Fano
(1971): the low l = floor(log2(last / n)) bits of each in fixed width, the rest as unary gaps in a bit
vector, 2 + l bits an integer: integers u32, l u32, bytes of the high part u32, select samples u32, low
part, high part, samples (u32). select(i), the place of the i-th one, starts from a sample of every
64th one. The n + 1 boundaries 0 = b[0] <= ... <= b[n] = ids give each document's start and length
without a table of offsets. Ids take two bytes when the vocabulary fits, four otherwise.

Documents are written in ascending doc_id order: partitions are ranges of doc_id, blocks in a
partition are in order, and `start_in_part` counts the ids before the block in its partition.

Defined cases: a null text is empty and has only the end id; null doc_ids come first; repeated
doc_ids are ordered by a hash of their text; an empty table gives an empty result; a text longer
than a block makes a block of its own. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import ready_workers, new_path

BLOCK_IDS = 1 << 19
CACHED_UNITS = 1_200_000
_HEAD = struct.Struct("<4sHHIIQq")
_PART = struct.Struct("<IIII")
_SAMPLE = 64
_LONG = 64
_WORDS = 100
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: One search for each is several times as fast as a pattern.
_OTHER_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class EliasFano:
    """A sorted sequence of integers below a bound, in near-minimal space, with constant-time access."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        packed = [np.packbits(b.ravel(), bitorder="little").tobytes() for b in (bits, high)]
        return cls(n, low_bits, *packed, ones[::_SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The place of the i-th one of the high part, counted from 0."""
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte, mask = at >> 3, 0xFF & (0xFF << (at & 7))
        while True:
            word = self.high[byte] & mask
            if (ones := word.bit_count()) > left:
                for _ in range(left):
                    word &= word - 1
                return 8 * byte + (word & -word).bit_length() - 1
            left, byte, mask = left - ones, byte + 1, 0xFF

    def __getitem__(self, i: int) -> int:
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return (self.select(i) - i) << self.low_bits | raw & ((1 << self.low_bits) - 1)

    def packed(self) -> bytes:
        return _PART.pack(self.n, self.low_bits, len(self.high), len(self.samples)) + self.low + self.high + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, blob: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence that is packed at a place of a blob, and the place behind it."""
        n, low_bits, n_high, n_samples = _PART.unpack_from(blob, at)
        low = at + _PART.size
        high = low + (n * low_bits + 7) // 8
        end = high + n_high + 4 * n_samples
        return cls(n, low_bits, blob[low:high], blob[high : high + n_high], np.frombuffer(blob, "<u4", n_samples, high + n_high)), end


def pack_block(doc_ids: list[int | None], parts: list[bytes], width: int) -> bytes:
    """One block of documents in the order of their doc_ids, those without first, given the little-endian ids of each."""
    known = [d for d in doc_ids if d is not None]
    n_null = len(doc_ids) - len(known)
    if any(d is not None for d in doc_ids[:n_null]) or known != sorted(known):
        raise ValueError("documents must come in ascending order of doc_id")
    bounds = np.concatenate([[0], np.cumsum([len(p) // width for p in parts])])
    least = known[0] if known else 0
    head = _HEAD.pack(b"EFTK", 2, width, len(parts), n_null, int(bounds[-1]), least)
    return b"".join([head, EliasFano.of(bounds).packed(), EliasFano.of(np.array([d - least for d in known], np.uint64)).packed(), *parts])


class Block:
    """A packed block: starts and lengths of documents by select over the boundaries."""

    def __init__(self, blob: bytes):
        magic, version, self.width, self.n, self._n_null, self.n_ids, self._least = _HEAD.unpack_from(blob)
        if magic != b"EFTK" or version != 2:
            raise ValueError("not a token block of version 2")
        self.bounds, at = EliasFano.read(blob, _HEAD.size)
        self._known, self._from = EliasFano.read(blob, at)
        self._blob = blob

    def doc_id(self, i: int) -> int | None:
        return None if i < self._n_null else self._least + self._known[i - self._n_null]

    def span(self, i: int) -> tuple[int, int]:
        """Where the ids of a document start and end."""
        return self.bounds[i], self.bounds[i + 1]

    def ids(self, i: int) -> np.ndarray:
        return self.between(*self.span(i))

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids from one boundary to another."""
        return np.frombuffer(self._blob, f"<u{self.width}", b - a, self._from + a * self.width)


def _parts_alike(tokenizer: object) -> bool:
    """Whether the file cuts texts as `UnitEncoder` takes for granted: byte level with its own pattern, nothing before it."""
    spec = json.loads(tokenizer.to_str())
    cut = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)


class UnitEncoder:
    """Encodes with the tokenizers library, remembering the ids of the units of texts.

    A byte-level pre-tokenizer starts a new piece at a space between two characters that are not white
    space, makes a lone line feed between two such characters a piece of its own, and parts a word of
    Latin letters from the signs behind it. So these units are encoded alike alone and together.
    The memory is bounded: it is emptied when it holds CACHED_UNITS units, and long units don't stay.
    With a file of another kind whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.in_units = _parts_alike(self.tokenizer)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocab = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)  # pieces that begin with a space
        self.leads[[i for piece, i in vocab.items() if piece.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}  # after a space
        self.bare: dict[str, bytes] = {}  # at the start of a text or line
        self.feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(x.ids, kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        """Remember units that follow a space."""
        known, bare = self.known, self.bare
        parted: dict[str, str] = {}
        plain, odd = set(), []
        for u in missing:
            stem = u.rstrip(_SIGNS)
            if stem.isalpha() and max(stem) < "\u0250":
                if len(stem) < len(u):
                    parted[u] = stem
                if stem not in known:
                    plain.add(stem)
            else:
                odd.append(u)
        self._learn_plain(list(plain))
        known.update(zip(odd, self._ids([" " + u for u in odd]), strict=True))
        tails = [t for t in {u[len(stem) :] for u, stem in parted.items()} if t not in bare]
        bare.update(zip(tails, self._ids(tails), strict=True))
        for u, stem in parted.items():
            known[u] = known[stem] + bare[u[len(stem) :]]

    def _learn_plain(self, missing: list[str]) -> None:
        """Many words in one text: the ids of each begin at a piece with a space."""
        kind = f"<u{self.width}"
        groups = [missing[i : i + _WORDS] for i in range(0, len(missing), _WORDS)]
        found = self.tokenizer.encode_batch_fast([" " + " ".join(some) for some in groups], add_special_tokens=False)
        for some, x in zip(groups, found, strict=True):
            ids = np.array(x.ids, kind)
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(some):
                self.known.update(zip(some, self._ids([" " + u for u in some]), strict=True))
                continue
            raw, at = ids.tobytes(), [*(starts * self.width).tolist(), len(ids) * self.width]
            self.known.update(zip(some, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))

    @staticmethod
    def _lines(text: str) -> list[list[str]]:
        """Lines of units: the first of a line follows nothing, each other follows a space."""
        if text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in _OTHER_SPACES):
            return [UnitEncoder._safe_units(text)]
        return [line.split(" ") for line in text.split("\n")]

    @staticmethod
    def _safe_units(text: str) -> list[str]:
        """Cut at spaces between two characters that are surely no white space only."""
        head, *rest = text.split(" ")
        out = [head]
        for piece in rest:
            if out[-1] and not out[-1][-1].isspace() and piece and not piece[0].isspace():
                out.append(piece)
            else:
                out[-1] += " " + piece
        return out

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        if not self.in_units:
            return [x + end for x in self._ids(texts)]
        known, bare = self.known, self.bare
        if len(known) > CACHED_UNITS:
            known.clear()
        if len(bare) > CACHED_UNITS // 8:
            bare.clear()
        split = [self._lines(t) for t in texts]
        heads = {line[0] for lines in split for line in lines}.difference(bare)
        bare.update(zip(heads, self._ids(list(heads)), strict=True))
        found, missing = [], set()
        for lines in split:
            for line in lines:
                got = list(map(known.get, line))
                got[0] = bare[line[0]]
                if not all(got):
                    missing.update(u for u, x in zip(line, got, strict=True) if x is None)
                found.append(got)
        if missing:
            self._learn(missing)
        out, at = [], 0
        for lines in split:
            parts = []
            for line in lines:
                got = found[at]
                at += 1
                if not all(got):
                    got = [known[u] if x is None else x for u, x in zip(line, got, strict=True)]
                if parts:
                    parts.append(self.feed)
                parts += got
            parts.append(end)
            out.append(b"".join(parts))
        for memory, new in ((known, missing), (bare, heads)):
            for u in new:
                if len(u) > _LONG:
                    del memory[u]
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder_of(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def in_slices(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about `most` characters at most, so that long texts don't add up."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the blocks under `path`."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        part, block, written = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal block, written, held
            n = held // encoder.width
            row = pd.DataFrame({"part": [part], "block": [block], "start_in_part": [written], "n_docs": [len(ids)], "n_ids": [n], "blob": [pack_block(ids, parts, encoder.width)]})
            block, written, held = block + 1, written + n, 0
            ids.clear()
            parts.clear()
            return row

        for batch in batches:
            texts = batch["text"].tolist()
            keys = [None if missing else int(d) for d, missing in zip(batch["doc_id"], batch["no_id"], strict=True)]
            for a, b in in_slices(texts):
                for key, raw in zip(keys[a:b], encoder.encode(texts[a:b], end), strict=True):
                    ids.append(key)
                    parts.append(raw)
                    held += len(raw)
                    if held >= BLOCK_IDS * encoder.width:
                        yield flush()
        if parts:
            yield flush()

    ready_workers(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc_id"), F.col(id_col).isNull().alias("no_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    # Rows of one id, and rows without, are parted by their text and their place: no id is one task's work.
    order = [F.desc("no_id"), F.asc("doc_id"), F.xxhash64("text"), F.asc("row")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    blocks = ordered.mapInPandas(encode, "part int, block int, start_in_part long, n_docs int, n_ids long, blob binary")
    blocks.write.option("compression", "zstd").option("maxRecordsPerFile", 32).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the blocks: doc_id, start, n_tokens, ids_crc32, part, block, nth (in its block)."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per written partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, nth, start, blob in zip(batch["part"], batch["block"], batch["start_in_part"], batch["blob"], strict=True):
                block = Block(blob)
                rows, at = [], block.bounds[0]
                for i in range(block.n):
                    end = block.bounds[i + 1]  # a document ends where the next one starts
                    rows.append((block.doc_id(i), start + at, end - at, zlib.crc32(block.between(at, end).astype("<u4").tobytes()), part, nth, i))
                    at = end
                out = pd.DataFrame(rows, columns=["doc_id", "in_part", "n_tokens", "ids_crc32", "part", "block", "nth"])
                yield out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    rows = blocks.select("part", "block", "start_in_part", "blob").mapInPandas(decode, "doc_id long, in_part long, n_tokens long, ids_crc32 long, part int, block int, nth int")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "nth")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files to the shared folder and describe each document from what was written."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
