"""SentencePiece encoding by a max-plus parallel scan over chunks of giant documents, and decoding.

A text of at most `chunk_chars` code points is encoded where it is read. A longer one is cut into
chunks of that size. The state at a cut is the piece that ends at it or reaches over it, with its
overhang. A chunk gives the matrix of best scores from each state at its left cut to each state at
its right cut; over (max, +) these matrices multiply associatively, so blocks of chunks are combined
first, then the blocks of a document, and the states at all cuts are read off on the way back. Then
each chunk is traced back alone between its two states.

Where pieces do not cross the start of a run of spaces, all paths of a chunk with such a start meet
there, and its matrix is the sum of a column and a row, which is how it is computed.

For BPE models the scores are 0 or minus infinity (see `pieces`) and the result is the library's.

Defined cases: a null text is empty and has no ids; repeated rows give repeated results; an empty
table gives an empty result; only the id and text columns are read. U+2581 in a text reads as a
space, as in the library, so decoding gives a space for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm.common import ready_workers, materialise
from seagrid.llm.pieces import MARK, Paths, Pieces, UnitMemory, load

CHUNK = 1 << 15
BLOCK = 64
TOGETHER = 64  # chunks that are traced at a time
START = (-2, 0, 0)  # a state: piece, its characters, those beyond the cut
State = tuple[int, int, int]
Matrix = dict[State, dict[State, float]]


class ScanEncoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memory = UnitMemory(pieces, Paths.ids, lambda u: np.array(pieces.encode_unit(u), np.int32).tobytes())

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of plain texts, unit by unit."""
        return (np.frombuffer(x, np.int32) for x in self.memory.of(texts))

    def states(self, left: str, right: str) -> list[State]:
        """All states at a cut between two contexts."""
        p, out = self.pieces, []
        for over in range(min(p.longest - 1, len(right)) + 1):
            for k in range(over + 1, min(p.longest, len(left) + over) + 1):
                if (piece := p.ids.get(left[len(left) - (k - over) :] + right[:over])) is not None:
                    out.append((piece, k, over))
        if left and any(e[0] < 0 for e in p.edges(left, len(left))):
            out.append((-1, 1, 0))
        return out

    def lattice(self, text: str, starts: dict[State, float], end: int, at_end: bool, back: dict | None = None) -> Matrix:
        """Best scores from each start state (at position 0) to each state at `end`; text reaches past `end`.

        back: gets the piece and place before each (place, last piece), for one start state.
        """
        p = self.pieces
        cells: list[dict[int, dict[State, float]]] = [{} for _ in range(len(text) + 1)]
        out: Matrix = {s: {} for s in starts}
        for s, score in starts.items():
            cells[s[2]].setdefault(s[0] if p.bpe else -2, {})[s] = score
            if s[2] == end:
                out[s][START if at_end else s] = score
        for at in range(1, min(len(text), end if at_end else end + p.longest - 1) + 1):
            for piece, k, score in p.edges(text, at):
                before = at - k
                if before >= end:
                    continue
                for last, vector in cells[before].items():
                    if not p.follows(last, piece):
                        continue
                    own = piece if p.bpe else -2
                    into = cells[at].setdefault(own, {}) if at < end else None
                    for s, v in vector.items():
                        if into is not None:
                            if v + score > into.get(s, float("-inf")):
                                into[s] = v + score
                                if back is not None:
                                    back[at, own] = (piece, k, before, last)
                        else:
                            x = START if at_end else (piece, k, at - end)
                            if v + score > out[s].get(x, float("-inf")):
                                out[s][x] = v + score
                                if back is not None:
                                    back["end", x] = (piece, k, before, last)
        return out

    def _cuts(self, body: str, before: str) -> tuple[int, int] | None:
        """The first and last place of the body where all paths meet."""
        if not self.pieces.cuts:
            return None
        near = before[-1:] + body
        at = [i for i in range(len(body)) if body[i] == MARK and (i + len(near) - len(body) > 0 and near[i + len(near) - len(body) - 1] != MARK)]
        return (at[0], at[-1]) if at else None

    def transfer(self, left: str, body: str, right: str, first: bool, last: bool) -> Matrix:
        entry = [START] if first else self.states(left, body)
        starts = {s: 0.0 for s in entry}
        if (cut := self._cuts(body, left)) is None:
            return self.lattice(body + right, starts, len(body), last)
        a, b = cut
        column = {s: x[START] for s, x in self.lattice(body[:a], {s: 0.0 for s in entry if s[2] <= a}, a, True).items() if x}
        middle = 0.0 if self.pieces.bpe else sum(self.pieces.forward(u)[2][-1] for u in self.pieces.units(body[a:b]))
        row = self.lattice(body[b:] + right, {START: 0.0}, len(body) - b, last)[START]
        return {s: {x: v + middle + w for x, w in row.items()} for s, v in column.items()}

    def _trace(self, text: str, start: State, end: int, goal: State, at_end: bool) -> list[int]:
        back: dict = {}
        self.lattice(text, {start: 0.0}, end, at_end, back)
        ids, key = [], ("end", START if at_end else goal)
        while key in back:
            piece, k, before, last = back[key]
            ids.append(self.pieces.spell(piece, text[before : before + k]))
            if before == start[2]:
                break
            key = (before, last)
        return [i for part in reversed(ids) for i in part]

    def trace(self, chunks: list[tuple[str, str, str, State, State, bool]]) -> list[np.ndarray]:
        """The ids of the pieces that start in each chunk (left, body, right, entry, goal, last), between its two states.

        What lies between the first and the last place where all paths meet is encoded for all chunks together.
        """
        heads, middles, tails = [], [], []
        for left, body, right, entry, goal, last in chunks:
            if (cut := self._cuts(body, left)) is None:
                heads.append(self._trace(body + right, entry, len(body), goal, last))
                middles.append("")
                tails.append([])
                continue
            a, b = cut
            heads.append(self._trace(body[:a], entry, a, START, True) if entry[2] < a else [])
            middles.append(body[a:b])
            tails.append(self._trace(body[b:] + right, START, len(body) - b, goal, last))
        return [np.concatenate([np.array(h, np.int32), np.frombuffer(m, np.int32), np.array(t, np.int32)]) for h, m, t in zip(heads, self.memory.of_marked(middles), tails, strict=True)]


def packed(matrix: Matrix) -> tuple[bytes, bytes]:
    """A matrix as two arrays: six integers, the two states, and a score for each of its entries."""
    entries = [(*s, *x, v) for s, row in matrix.items() for x, v in row.items()]
    return np.array([e[:6] for e in entries], "<i4").tobytes(), np.array([e[6] for e in entries], "<f8").tobytes()


def unpacked(states: bytes, scores: bytes) -> Matrix:
    out: Matrix = {}
    for (a, b, c, *x), v in zip(np.frombuffer(states, "<i4").reshape(-1, 6).tolist(), np.frombuffer(scores, "<f8").tolist(), strict=True):
        out.setdefault((a, b, c), {})[tuple(x)] = v
    return out


def compose(first: Matrix, second: Matrix) -> Matrix:
    """The max-plus product."""
    out: Matrix = {}
    for s, row in first.items():
        got: dict[State, float] = {}
        for m, v in row.items():
            for x, w in second.get(m, {}).items():
                if v + w > got.get(x, float("-inf")):
                    got[x] = v + w
        out[s] = got
    return out


def states_between(matrices: list[Matrix], start: State, goal: State) -> list[State]:
    """The states on the best path from start to goal: before the first matrix, between all, after the last."""
    ahead: list[dict[State, float]] = [{start: 0.0}]
    for m in matrices:
        got: dict[State, float] = {}
        for s, v in ahead[-1].items():
            for x, w in m.get(s, {}).items():
                if v + w > got.get(x, float("-inf")):
                    got[x] = v + w
        ahead.append(got)
    path = [goal]
    for m, before in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        path.append(max((s for s in before if path[-1] in m.get(s, {})), key=lambda s: before[s] + m[s][path[-1]]))
    return path[::-1]


_encoders: dict[str, ScanEncoder] = {}


def _encoder(model: str) -> ScanEncoder:
    if model not in _encoders:
        _encoders[model] = ScanEncoder(load(model))
    return _encoders[model]


def _chunks(giant: DataFrame, model: str, size: int) -> DataFrame:
    """Rows (uid, chunk, n_chunks, doc_id, text_hash, before, body, after); a uid for each row of the input."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(model)
        near, uid = pieces.longest, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, no_id, text, text_hash in zip(batch["doc_id"], batch["no_id"], batch["text"], batch["text_hash"], strict=True):
                marked = pieces.marked(text)
                at = [size * i for i in range(max(1, len(marked) // size))] + [len(marked)]
                yield pd.DataFrame(
                    {
                        "uid": uid, "chunk": np.arange(len(at) - 1), "n_chunks": len(at) - 1, "doc_id": doc_id, "no_id": no_id, "text_hash": text_hash,
                        "before": [marked[max(0, a - near) : a] for a in at[:-1]],
                        "body": [marked[a:b] for a, b in zip(at[:-1], at[1:], strict=True)],
                        "after": [marked[b : b + near] for b in at[1:]],
                    }
                )
                uid += 1

    schema = "uid long, chunk int, n_chunks int, doc_id long, no_id boolean, text_hash long, before string, body string, after string"
    return materialise(giant.mapInPandas(cut, schema).repartition("uid", "chunk"), "chunks")


def _cut_states(chunks: DataFrame, model: str) -> DataFrame:
    """Rows (uid, chunk, ends): the states at both cuts of each chunk, three integers each."""

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model)
        for batch in batches:
            made = [packed(encoder.transfer(r.before, r.body, r.after, r.chunk == 0, r.chunk == r.n_chunks - 1)) for r in batch.itertuples()]
            yield pd.DataFrame({"uid": batch["uid"], "chunk": batch["chunk"], "block": batch["chunk"] // BLOCK, "states": [m[0] for m in made], "scores": [m[1] for m in made]})

    def read(pdf: pd.DataFrame) -> list[Matrix]:
        return list(map(unpacked, pdf["states"], pdf["scores"]))

    def pairs(path: list[State]) -> list[list[int]]:
        return [[*a, *b] for a, b in zip(path[:-1], path[1:], strict=True)]

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        states, scores = packed(reduce(compose, read(pdf.sort_values("chunk"))))
        return pd.DataFrame({"uid": pdf["uid"].iloc[:1], "block": pdf["block"].iloc[:1], "states": [states], "scores": [scores]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"uid": pdf["uid"], "block": pdf["block"], "ends": pairs(states_between(read(pdf), START, START))})

    def inside(key: tuple, matrices: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        matrices, (start, goal) = matrices.sort_values("chunk"), _two_states(ends["ends"].iloc[0])
        return pd.DataFrame({"uid": matrices["uid"], "chunk": matrices["chunk"], "ends": pairs(states_between(read(matrices), start, goal))})

    matrices = materialise(chunks.mapInPandas(transfers, "uid long, chunk int, block int, states binary, scores binary"), "transfers")
    blocks = matrices.groupBy("uid", "block").applyInPandas(in_block, "uid long, block int, states binary, scores binary")
    ends = blocks.groupBy("uid").applyInPandas(along, "uid long, block int, ends array<int>")
    return matrices.groupBy("uid", "block").cogroup(ends.groupBy("uid", "block")).applyInPandas(inside, "uid long, chunk int, ends array<int>")


def _two_states(ends: np.ndarray) -> tuple[State, State]:
    return tuple(map(int, ends[:3])), tuple(map(int, ends[3:]))


def encode(docs: DataFrame, model: str, chunk_chars: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, n_chunks, text_hash (xxhash64 of the text, spaces for U+2581)."""

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model)
        for batch in batches:
            batch["ids"] = list(encoder.encode(batch["text"].tolist()))
            yield batch[["doc_id", "no_id", "text_hash", "ids"]]

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model)
        for batch in batches:
            chunks = [(r.before, r.body, r.after, *_two_states(r.ends), r.chunk == r.n_chunks - 1) for r in batch.itertuples()]
            batch["ids"] = [ids for i in range(0, len(chunks), TOGETHER) for ids in encoder.trace(chunks[i : i + TOGETHER])]
            yield batch[["uid", "chunk", "doc_id", "no_id", "text_hash", "ids"]]

    spark = docs.sparkSession
    ready_workers(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc_id"), F.col(id_col).isNull().alias("no_id"), text.alias("text"), F.xxhash64(F.translate(text, MARK, " ")).alias("text_hash"))
    short = slim.where(F.length("text") < chunk_chars).mapInPandas(alone, "doc_id long, no_id boolean, text_hash long, ids array<int>").withColumn("n_chunks", F.lit(1))
    chunks = _chunks(slim.where(F.length("text") >= chunk_chars), model, chunk_chars)
    met = chunks.join(_cut_states(chunks, model), ["uid", "chunk"]).select("uid", "chunk", "n_chunks", "doc_id", "no_id", "text_hash", "before", "body", "after", "ends")
    parts = met.mapInPandas(traced, "uid long, chunk int, doc_id long, no_id boolean, text_hash long, ids array<int>")
    whole = parts.groupBy("uid", "doc_id", "no_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select("doc_id", "no_id", "text_hash", F.flatten(F.col("parts.ids")).alias("ids"), F.size("parts").alias("n_chunks"))
    rows = short.unionByName(whole)
    return rows.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", "text_hash")


def decoder(model: str):
    """A function of a column of ids that gives the texts; null for null ids."""
    ready_workers(SparkSession.active())

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        pieces = load(model)
        table = [b""] * len(pieces.score)
        for i, t in pieces.text.items():
            table[i] = t.replace(MARK, " ").encode()
        for b in range(256):
            table[pieces.byte0 + b] = bytes([b])
        return pd.Series([None if x is None else b"".join(map(table.__getitem__, x.tolist())).decode("utf-8", "replace")[1:] for x in ids], dtype=object)

    return decode


def decode(ids: Column | str, model: str) -> Column:
    return decoder(model)(ids)
