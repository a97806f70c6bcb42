"""The pieces of a SentencePiece model and the lattice that encodes a text with them.

Two kinds of model, as the file says. In a unigram model an edge of the lattice has its piece's
score and the best path wins. In a BPE model a sequence of pieces is the encoding exactly when each
neighbouring pair is the encoding of its own concatenation, so an edge costs nothing and a pair
that is no such encoding is not allowed; one path is left. Both are sums maximised over paths, and
the last piece on the best path to every prefix is the last piece of that prefix's encoding.

Characters that no piece has become the bytes of their UTF-8 form (models without byte fallback are
not supported). The model's own normalisation must be the identity with a leading space added and
white space kept, as in the public file; anything else is refused when the model is loaded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

MARK = "▁"
_NEVER = float("-inf")
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LINE_UNIT = re.compile(f"{MARK}+[^{MARK}\\n]*|\\n|[^{MARK}\\n]+")
_PAIRS = 400_000
_PAIR_SLOTS = 1 << 20
_UNITS = 300_000
_SHORT = 64
_AT_ONCE = 400_000  # characters of units that go through the lattice together
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """A fixed map from integers to integers, looked up for whole arrays; -1 where there is none."""

    def __init__(self, entries: dict[int, int]):
        bits = max(4, (4 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = (np.fromiter(x, np.int64, len(entries)) for x in (entries.keys(), entries.values()))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], at[~own] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found, out = self.keys[at], self.values[at]
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            found[left], out[left] = self.keys[at[left]], self.values[at[left]]
            left = left[(found[left] != keys[left]) & (found[left] >= 0)]
        return out


class Pieces:
    """A loaded model. Ids at or above `byte0` and below `byte0 + 256` stand for bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation with a leading space is supported")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback are supported")
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.text = {i: p for p, i in self.ids.items()}
        self.score = [p.score for p in proto.pieces]
        self.byte0 = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE)
        self.longest = max(map(len, self.ids))
        self.chars = set("".join(self.ids))
        self.byte_score = min(p.score for p in proto.pieces if p.type == kinds.NORMAL) - 10
        #: No piece goes on past the start of a new run of spaces: what stands before and after one is encoded alone.
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.feeds = self.cuts and "\n" not in self.chars
        if self.bpe and not self.chars <= self.ids.keys():
            raise ValueError("only models with a piece for each character of a piece are supported")
        norm.add_dummy_prefix = False
        self._bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self._pairs: dict[int, bool] = {}
        if self.bpe:
            self._index()

    def _index(self) -> None:
        """The pieces, read backwards, as a trie of arrays, and a table of the pairs met before."""
        self._class = np.zeros(0x110000, np.uint16)
        self._class[[ord(c) for c in sorted(self.chars)]] = np.arange(1, len(self.chars) + 1)
        number = {c: i + 1 for i, c in enumerate(sorted(self.chars))}
        nodes: dict[int, int] = {}
        ends = {}
        for piece, i in self.ids.items():
            at = 0
            for c in reversed(piece):
                at = nodes.setdefault(at << 16 | number[c], len(nodes) + 1)
            ends[at] = i
        self._trie = _Table(nodes)
        self._ends = np.full(len(nodes) + 1, -1, np.int32)
        self._ends[list(ends)] = list(ends.values())
        self._pair_keys, self._pair_ok = np.full(_PAIR_SLOTS, -1, np.int64), np.zeros(_PAIR_SLOTS, bool)

    def _follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`follows` of arrays of pieces; left is negative where there is none."""
        keys = left.astype(np.int64) << 20 | right
        at = (keys.astype(np.uint64) * _MIX >> np.uint64(64 - _PAIR_SLOTS.bit_length() + 1)).astype(np.int64)
        ok = self._pair_ok[at] | (left < 0)
        new = np.flatnonzero((self._pair_keys[at] != keys) & (left >= 0))
        if len(new):
            pairs, which = np.unique(keys[new], return_inverse=True)
            both = list(zip((pairs >> 20).tolist(), (pairs & (1 << 20) - 1).tolist(), strict=True))
            alone = self._bare.encode([(self.text[a] + self.text[b]).replace(MARK, " ") for a, b in both], num_threads=1)
            good = np.array([x == [a, b] for x, (a, b) in zip(alone, both, strict=True)], bool)
            ok[new] = good[which]
            self._pair_keys[at[new]], self._pair_ok[at[new]] = keys[new], ok[new]
        return ok

    def marked(self, text: str) -> str:
        """The text as the model sees it."""
        return MARK + text.replace(" ", MARK) if text else ""

    def units(self, marked: str) -> list[str]:
        """Parts that are encoded independently: cut before runs of spaces and, where no piece has it, around line feeds."""
        if not self.cuts:
            return [marked] if marked else []
        return (_LINE_UNIT if self.feeds else _UNIT).findall(marked)

    def follows(self, left: int, right: int) -> bool:
        """Whether `right` may come after `left`."""
        if not self.bpe or left < 0 or left not in self.text or right not in self.text:
            return True
        key = left << 20 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > _PAIRS:
                self._pairs.clear()
            a, b = self.text[left], self.text[right]
            if self.cuts and b[0] == MARK and a[-1] != MARK:
                known = True
            else:
                known = self._bare.encode((a + b).replace(MARK, " ")) == [left, right]
            self._pairs[key] = known
        return known

    def edges(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(piece, characters, score) of each edge that ends at position `at`; a character without a piece is piece -1."""
        c = text[at - 1]
        if c not in self.chars or c not in self.ids and not self.bpe:
            return [(-1, 1, self.byte_score)] + ([] if c not in self.chars else self._found(text, at))
        return self._found(text, at)

    def _found(self, text: str, at: int) -> list[tuple[int, int, float]]:
        out, ids = [], self.ids
        for n in range(min(self.longest, at), 0, -1):
            if (p := ids.get(text[at - n : at])) is not None:
                out.append((p, n, 0.0 if self.bpe else self.score[p]))
        if not out or self.bpe and out[-1][1] > 1:  # a character that only longer pieces have
            out.append((-1, 1, self.byte_score if not self.bpe else 0.0))
        return out

    def forward(self, text: str) -> tuple[list[int], list[int], list[float]]:
        """For each prefix of a marked text: its last piece, that piece's characters, the path's score."""
        n = len(text)
        last, size, best = [-2] * (n + 1), [0] * (n + 1), [0.0 if self.bpe else _NEVER] * (n + 1)
        best[0] = 0.0
        if self.bpe:
            self._forward_bpe(text, last, size)
            return last, size, best
        for at in range(1, n + 1):
            for piece, k, score in self.edges(text, at):
                before = at - k
                if best[before] + score > best[at]:
                    last[at], size[at], best[at] = piece, k, best[before] + score
        return last, size, best

    def _forward_bpe(self, text: str, last: list[int], size: list[int]) -> None:
        """As above where every prefix has one path, so the first edge found is the edge."""
        ids, pairs, longest = self.ids, self._pairs, self.longest
        for at in range(1, len(text) + 1):
            for k in range(longest if at > longest else at, 0, -1):
                if (p := ids.get(text[at - k : at])) is None:
                    continue
                left = last[at - k]
                if left >= 0 and (ok := pairs.get(left << 20 | p)) is not True and (ok is False or not self.follows(left, p)):
                    continue
                last[at], size[at] = p, k
                break
            else:
                last[at], size[at] = -1, 1

    def paths(self, units: list[str]) -> Paths:
        """`forward` of many short units of a BPE model at once: one step for each place, over all units that reach it."""
        n = len(units)
        lens = np.fromiter(map(len, units), np.int64, n)
        order = np.argsort(-lens, kind="stable")
        text = "".join([units[i] for i in order])
        lens = lens[order]
        starts = np.cumsum(lens) - lens
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = self._class[codes].astype(np.int64)
        place = np.arange(len(codes)) - np.repeat(starts, lens)

        # All pieces that end at each place: bit k - 1 of `found` for one of k characters.
        piece, found = np.full((self.longest, len(codes)), -1, np.int32), np.zeros(len(codes), np.int64)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(self.longest):
            node = self._trie[node << 16 | classes[at - k]]
            here = node >= 0
            at, node = at[here], node[here].astype(np.int64)
            end = self._ends[node]
            some = end >= 0
            piece[k, at[some]] = end[some]
            found[at[some]] |= 1 << k
            on = place[at] > k
            at, node = at[on], node[on]
            if not len(at):
                break

        last, size = np.full(len(codes), -1, np.int32), np.ones(len(codes), np.int32)
        reach = np.searchsorted(-lens, -np.arange(int(lens[0]) if n else 0), side="left")
        for p, m in enumerate(reach.tolist()):
            ends = starts[:m] + p
            left = found[ends]
            todo = np.flatnonzero(left)
            while len(todo):
                k = np.frexp(left[todo].astype(np.float64))[1]
                e = ends[todo]
                what = piece[k - 1, e]
                before = np.where(k <= p, last[e - np.minimum(k, p)], -2)
                ok = self._follow(before, what)
                last[e[ok]], size[e[ok]] = what[ok], k[ok]
                todo, k = todo[~ok], k[~ok]
                left[todo] ^= np.left_shift(np.int64(1), k - 1)
                todo = todo[left[todo] != 0]
        return Paths(self, order, starts, lens, codes, last, size, reach)

    def spell(self, piece: int, text: str) -> list[int]:
        """The ids of one edge: the piece, or the bytes of its character."""
        return [piece] if piece >= 0 else [self.byte0 + b for b in text.encode()]

    def encode_unit(self, text: str) -> list[int]:
        last, size, _ = self.forward(text)
        at, out = len(text), []
        while at:
            out.append(self.spell(last[at], text[at - size[at] : at]))
            at -= size[at]
        return [i for ids in reversed(out) for i in ids]

    def steps_of_unit(self, text: str) -> bytes:
        """What each character adds to the tokens of the encoding of the prefix that ends with it, as signed bytes."""
        last, size, _ = self.forward(text)
        counts = [0]
        for at in range(1, len(text) + 1):
            counts.append(counts[at - size[at]] + (1 if last[at] >= 0 else len(text[at - 1].encode())))
        return bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])


class Paths:
    """The last piece and its characters of every prefix of many units, longest unit first, one after the other."""

    def __init__(self, pieces: Pieces, order: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray, last: np.ndarray, size: np.ndarray, reach: np.ndarray):
        self.pieces, self.order, self.starts, self.lens, self.last, self.size, self.reach = pieces, order, starts, lens, last, size, reach
        self.codes = codes
        #: Tokens of a last piece: one, or the bytes of a character without a piece.
        self.weight = np.where(last >= 0, 1, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).astype(np.int32)

    def _parts(self, raw: bytes, bounds: np.ndarray) -> list[bytes]:
        """The slices of the units in the order in which they were given."""
        at = bounds.tolist()
        out: list[bytes] = [b""] * len(self.order)
        for i, a, b in zip(self.order.tolist(), at[:-1], at[1:], strict=True):
            out[i] = raw[a:b]
        return out

    def steps(self) -> list[bytes]:
        """As `steps_of_unit`, for each unit."""
        counts = np.zeros(len(self.last), np.int32)
        for p, m in enumerate(self.reach.tolist()):
            e = self.starts[:m] + p
            k = self.size[e]
            counts[e] = np.where(k <= p, counts[e - np.minimum(k, p)], 0) + self.weight[e]
        steps = np.diff(counts, prepend=np.int32(0))
        steps[self.starts] = counts[self.starts]
        return self._parts(steps.astype(np.int8).tobytes(), np.append(self.starts, len(counts)))

    def ids(self) -> list[bytes]:
        """As `encode_unit`, for each unit, in four bytes each."""
        on = np.zeros(len(self.last), bool)
        at, first = self.starts + self.lens - 1, self.starts
        while len(at):
            on[at] = True
            at = at - self.size[at]
            here = at >= first
            at, first = at[here], first[here]
        weight = np.where(on, self.weight, 0)
        bounds = np.concatenate([[0], np.cumsum(weight)])
        ids = np.repeat(self.last, weight)
        for e in np.flatnonzero(on & (self.last < 0)).tolist():
            ids[bounds[e] : bounds[e + 1]] = self.pieces.spell(-1, chr(self.codes[e]))
        return self._parts(ids.tobytes(), 4 * bounds[np.append(self.starts, len(on))])


class UnitMemory:
    """What is made of each unit of a text, remembered for up to `most` units, then forgotten.

    of_paths makes it for short units of a BPE model together, alone for one other unit.
    """

    def __init__(self, pieces: Pieces, of_paths: Callable[[Paths], list[bytes]], alone: Callable[[str], bytes], most: int = _UNITS):
        self.pieces, self.of_paths, self.alone, self.most = pieces, of_paths, alone, most
        self.known: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> list[str]:
        """Remember the units; gives those that are too long to stay."""
        short = [u for u in missing if len(u) <= _SHORT] if self.pieces.bpe else []
        start = size = 0
        for i, u in enumerate(short):
            size += len(u)
            if size > _AT_ONCE or i == len(short) - 1:
                self.known.update(zip(short[start : i + 1], self.of_paths(self.pieces.paths(short[start : i + 1])), strict=True))
                start, size = i + 1, 0
        long = [u for u in missing if len(u) > _SHORT]
        for u in missing if not self.pieces.bpe else long:
            self.known[u] = self.alone(u)
        return long

    def of_marked(self, texts: list[str]) -> list[bytes]:
        """The values of the units of each marked text, end to end."""
        if len(self.known) > self.most:
            self.known.clear()
        units = [self.pieces.units(t) for t in texts]
        known = self.known
        long = self._learn(list(set(chain.from_iterable(units)).difference(known)))
        out = [b"".join(map(known.__getitem__, u)) for u in units]
        for u in long:
            del known[u]
        return out

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The values of plain texts; those of few texts are held at a time."""
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > 10 * _AT_ONCE:
                yield from self.of_marked(some)
                some, size = [], 0
            some.append(self.pieces.marked(t))
            size += len(t)
        yield from self.of_marked(some)


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]
