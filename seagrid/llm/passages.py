"""Substring deduplication by MinHash banding of paragraphs.

A paragraph is a line of at least `min_words` words. Its 5-word shingles give a MinHash signature of
bands x rows values; paragraphs that agree in one band meet in a bucket. Tuned for recall, 10 bands
of 3 rows find a pair of similarity 0.8 with probability 0.9992. In a bucket every member is compared
by exact Jaccard similarity with the bucket's most central text, the one that meets most others in
all its buckets, which in a group of edited copies is the unedited one. Members linked to it are
linked to each other by it. The others are compared with leaders of their own, in rounds. Members that
are then still in different components are joined if they can be similar enough, by the rarest
shingles in which they differ from the central text; the bound on these is exact, so no two components
with a link in a bucket stay apart, whatever its size. Links of at least `similarity` form components,
and all occurrences but the first of a component are to be removed. Shingles are compared by 64-bit
hashes.

A repeated passage need not be a paragraph: it can stand inside longer lines or run over several. So
the text's windows of `WINDOW` words are winnowed: of each `CHOICE` neighbouring windows the one with
the least hash is chosen, which depends on its words only. Documents that share WINDOW + CHOICE - 1
words (50) share a chosen window for certain. Chosen windows that several documents have are repeats.
Each is extended both ways while the words agree with those of its first occurrence, and in a document
those that overlap or touch are joined to a span.

Equal texts are one document to all of this, and the row of the least id stands for them; each other
row of such a text is one passage, of kind `text`. So copies are never compared, and a hot text is
counted before the shuffle. A text is known by two 64-bit hashes, a row by its text and its place in
the input.

Defined cases: null and empty texts have no passages; words are split at ASCII white space and A-Z
lower-cased; rows without an id come last among occurrences and are documents of their own; a row
repeated exactly is a `text` that goes; rows of one id with different texts are different documents;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.llm.bloom import among
from seagrid.llm.common import connected_components, materialise, ready_workers, release

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 25
BANDS, ROWS = 10, 3
WINDOW, CHOICE = 25, 26
REACH = CHOICE - 1
SEED = 5
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Sums:
    """Running sums of mark * factor**place over words, from which the hash of any run of words follows."""

    def __init__(self, marks: np.ndarray):
        n = len(marks)
        up, self.down = np.full(n + 1, _FACTOR, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[0] = self.down[0] = 1
        self.down = np.cumprod(self.down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks * np.cumprod(up)[:n])])

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """A 64-bit hash of each run of words."""
        h = (self.sums[starts + lengths] - self.sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def window_hashes(marks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    return Sums(marks).hashes(np.arange(max(0, len(marks) - window + 1)), window)


def shingle_hashes(marks: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, as unsigned, from the marks of the words."""
    return np.unique(window_hashes(marks, min(k, len(marks))))


class Signer:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One key per band for each run of shingles, the number of the band in its low four bits; `starts` of the runs, none empty."""
        mixed = shingles ^ (shingles >> np.uint64(31))
        out = np.tile(np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(starts), 1))
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            band = out[:, i // self.rows]
            band ^= np.minimum.reduceat((mixed * a + b) >> np.uint64(16), starts)
            band *= np.uint64(0xFF51AFD7ED558CCD)
            band ^= band >> np.uint64(33)
        return out & ~np.uint64(15) | np.arange(self.bands, dtype=np.uint64)


def winnow(hashes: np.ndarray, choice: int = CHOICE) -> np.ndarray:
    """Places of the least hash, the last of equal ones, of each `choice` neighbours (of all, if fewer)."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    choice = min(choice, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], choice)
    best = views.argmin(1) + np.arange(len(views))
    return len(hashes) - 1 - np.unique(best)[::-1]


_marks: dict[bytes, int] = {}


def _mark(words: list[bytes]) -> np.ndarray:
    if len(_marks) > 250_000:
        _marks.clear()
    known = _marks
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


#: What names a text, and the row that stands for it.
_OWNER = ["t1", "t2", "no_id", "doc_id"]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (t1, t2, no_id, doc_id, text) of the documents with a text."""
    ready_workers(docs.sparkSession)
    text = F.col(text_col)
    named = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc_id"), text.alias("text"))
    return named.where("text is not null")


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs, one run after the other, and where each begins among them."""
    at = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(at - starts, lengths), at


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (t1, t2, no_id, doc_id, first_word, n_words, h, keys, kind) of kind 0, paragraphs; 1, chosen windows; 2, whole texts.

    first_word counts the words of the whole text from 0; keys are the bands of a paragraph.
    """
    if min_words < SHINGLE:
        raise ValueError("a paragraph has as many words as a shingle at least")

    def found(texts: list[str], signer: Signer) -> Iterator[tuple]:
        """(kind, text of the slice, first word, words, hash, keys) as arrays, for each kind."""
        words, per_line, per_text = [], [], []
        for text in texts:
            lines = [line.split() for line in text.encode().translate(_LOWER).split(b"\n")]
            per_line += map(len, lines)
            per_text.append(len(lines))
            words += chain.from_iterable(lines)
        sums = Sums(_mark(words))
        size, owner = np.array(per_line, np.int64), np.repeat(np.arange(len(texts)), per_text)
        start, whole = np.cumsum(size) - size, np.bincount(owner, size, len(texts)).astype(np.int64)
        first = np.cumsum(whole) - whole
        long = np.flatnonzero(size >= min_words)
        if len(long):
            places, runs = _runs(start[long], size[long] - SHINGLE + 1)
            keys = signer.keys(sums.hashes(places, SHINGLE), runs).view(np.int64)
            yield 0, owner[long], start[long] - first[owner[long]], size[long], sums.hashes(start[long], size[long]), list(keys)
        some = np.flatnonzero(whole >= WINDOW)
        chosen = []
        for i in some:
            h = sums.hashes(np.arange(first[i], first[i] + whole[i] - WINDOW + 1), WINDOW)
            at = winnow(h)
            chosen.append((np.full(len(at), i), at, h[at]))
        if chosen:
            own, at, h = (np.concatenate(x) for x in zip(*chosen, strict=True))
            yield 1, own, at, np.full(len(at), WINDOW), h, [None] * len(at)
        yield 2, np.arange(len(texts)), np.zeros(len(texts), np.int64), whole, np.zeros(len(texts), np.uint64), [None] * len(texts)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer()
        for batch in batches:
            texts, owners = batch["text"].tolist(), {c: batch[c].to_numpy() for c in _OWNER}
            for a, b in _slices(texts):
                for kind, own, at, n, h, keys in found(texts[a:b], signer):
                    yield pd.DataFrame({c: x[a + own] for c, x in owners.items()} | {"first_word": at, "n_words": n, "h": h.view(np.int64), "keys": keys, "kind": kind})

    return _slim(docs, id_col, text_col).mapInPandas(read, "t1 long, t2 long, no_id boolean, doc_id long, first_word int, n_words int, h long, keys array<long>, kind byte")


def _read_again(docs: DataFrame, wanted: DataFrame, read: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    """read of batches with a text, its owner and its rows of `wanted`, a list for each further column; one row for each text.

    Only rows that stand for a wanted text are shuffled; rows of equal id and text are one before that.
    """
    rest = [c for c in wanted.columns if c not in _OWNER]
    held = wanted.groupBy(*_OWNER).agg(F.collect_list(F.struct(*rest)).alias("w"))
    held = materialise(held.select(*_OWNER, F.xxhash64(*_OWNER).alias("key"), *[F.col(f"w.{c}").alias(c) for c in rest]), "wanted")
    near = among(_slim(docs, id_col, text_col).withColumn("key", F.xxhash64(*_OWNER)), held.select("key"), exact=False)
    texts = near.groupBy(*_OWNER).agg(F.first("text").alias("text"))
    return texts.join(held.drop("key"), _OWNER).mapInPandas(read, schema)


def _shingles_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (h, shingles) of the wanted paragraphs, read again from the texts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hs, out = [], []
            for text, first, n, h in zip(batch["text"], batch["first_word"], batch["n_words"], batch["h"], strict=True):
                words = _words(text)
                for a, k, x in zip(first, n, h, strict=True):
                    hs.append(x)
                    out.append(shingle_hashes(_mark(words[a : a + k])).view(np.int64))
            yield pd.DataFrame({"h": np.array(hs, np.int64), "shingles": out})

    one = F.min(F.struct("no_id", "doc_id", "t1", "t2", "first_word", "n_words")).alias("at")
    at = among(rows.where("kind = 0").withColumn("key", F.col("h")), wanted.select(F.col("h").alias("key"))).groupBy("h").agg(one)
    return _read_again(docs, at.select(*[f"at.{c}" for c in (*_OWNER, "first_word", "n_words")], "h"), read, "h long, shingles array<long>", id_col, text_col)


def _similar(pairs: DataFrame, shingles: DataFrame, similarity: float, unlike: bool = False) -> DataFrame:
    """pairs (a, b) with a column `linked`: whether the exact Jaccard similarity is enough.

    With `unlike` also na, nb, the numbers of shingles, and `apart`, the shingles that only one of the two has.
    """
    a = shingles.select(F.col("h").alias("a"), F.col("shingles").alias("sa"))
    b = shingles.select(F.col("h").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(a, "a").join(b, "b").withColumn("both", both)
    more = [F.size("sa").alias("na"), F.size("sb").alias("nb"), F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("apart")] if unlike else []
    return met.select("a", "b", (F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both"))).alias("linked"), *more)


def _leaders(stars: DataFrame, similarity: float, least: int = 4, most: int = 8) -> DataFrame:
    """Links (a, b) between members of one head that are not linked to it, at one comparison a member and round.

    In a round the open members of a head are parted by the least hash of the shingles in which they differ from it, with
    another seed each time, so that members like each other tend to meet. The one with fewest differences leads its part,
    and those linked to their leader are open no more. After `least` rounds it ends when one links less than a tenth of them.
    """
    now = stars.where(~F.col("linked")).select(F.col("b").alias("head"), F.col("a").alias("h"), F.col("na").alias("n"), "apart")
    links, kept = [stars.limit(0).select("a", "b")], []
    for k in range(most):
        seed = F.lit(k)
        now = materialise(now.withColumn("part", F.array_min(F.transform("apart", lambda x: F.xxhash64(seed, x)))), "open")  # noqa: B023
        lead = now.groupBy("head", "part").agg(F.min(F.struct(F.size("apart").alias("size"), "h")).alias("lead"), F.count("*").alias("members")).where("members > 1")
        lead = lead.select("head", "part", F.col("lead.h").alias("h")).join(now, ["head", "part", "h"])
        # Leaders are stored, so that Spark splits the join on a hot part.
        lead = materialise(lead.select("head", "part", F.col("h").alias("c"), F.col("n").alias("nc"), F.col("apart").alias("apart_c")), "leaders")
        shared = F.size(F.array_intersect("apart", "apart_c"))
        both = (F.col("n") + F.col("nc") - F.size("apart") - F.size("apart_c")) / 2 + shared
        met = now.join(lead, ["head", "part"]).where("h <> c").where(both >= similarity * (F.col("n") + F.col("nc") - both))
        met = materialise(met.select("head", "h", "c"), "led")
        links.append(met.select(F.col("h").alias("a"), F.col("c").alias("b")))
        kept += [now, lead, met]
        n_open, n_led = now.count(), met.count()
        now = now.join(met.select("head", "h"), ["head", "h"], "left_anti").drop("part")
        if not n_open or (k + 1 >= least and n_led * 10 < n_open):
            break
    found = materialise(reduce(DataFrame.unionByName, links), "led")
    release(*kept)
    return found


def _unlinked_pairs(stars: DataFrame, similarity: float, classes: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of members of one head that can be similar enough and are of different classes; none that is gets lost.

    `classes` has rows (h, class) of members known to be connected, those linked to one head among them; a member without
    a row is a class of its own. Left out, the classes are the members linked to the head and each other member.

    With A and B the shingles in which the members differ from the head c, |a ^ b| = |A| + |B| - 2 |A & B|, and similar
    enough means |a ^ b| <= r (|a| + |b|) with r = (1 - s) / (1 + s). So A and B share at least
    (|A| + |B| - r (|a| + |b|)) / 2 of them, which is above 0 where |A| > r (|a| + |c|), and then the first shared one,
    in any order, stands early in both. In the order from the rarest on, few others share an early one. Of those that
    do, one is always outside of the commonest class, so members of one class are never joined to each other.
    """
    r, eps = (1 - similarity) / (1 + similarity), 1e-6
    group = stars.select(F.col("b").alias("head"), F.col("a").alias("h"), "linked", F.col("na").alias("n"), F.col("nb").alias("nc"), F.size("apart").alias("size"), "apart")
    if classes is None:
        group = group.withColumn("class", F.when(F.col("linked"), F.col("head")).otherwise(F.col("h")))
    else:
        group = group.join(classes, "h", "left").withColumn("class", F.coalesce("class", "h"))
    mixed = group.groupBy("head").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("head")
    group = materialise(group.join(mixed, "head", "left_semi"), "group")
    each = group.select("head", "h", F.explode("apart").alias("x"))
    often = each.groupBy("head", "x").agg(F.count("*").alias("often")).where("often > 1")
    # Shingles that one member alone has come first in the order, and match none.
    ranked = each.join(often, ["head", "x"]).groupBy("head", "h").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("xs"))
    ranked = ranked.join(group.drop("apart"), ["head", "h"]).select("head", "h", "class", "linked", "n", "nc", "size", (F.col("size") - F.size("xs")).alias("alone"), F.posexplode("xs").alias("at", "x"))
    ranked = ranked.select("head", "h", "class", "linked", "n", "size", "nc", (F.col("alone") + F.col("at") + 1).alias("at"), F.col("x.x").alias("x"))
    least = lambda shared: F.greatest(F.ceil(shared / 2 - eps), F.lit(1))
    any_other = least(F.col("size") - r * (F.col("n") + F.col("nc")))
    a_lone = least(F.col("size") + r * (F.col("nc") - F.col("n")))
    early = materialise(ranked.where(F.col("at") <= F.col("size") - F.when(F.col("linked"), a_lone).otherwise(F.least(any_other, a_lone)) + 1), "early")
    sizes = early.groupBy("head", "x", "class").agg(F.count("*").alias("of_class"))
    commonest = sizes.groupBy("head", "x").agg(F.max_by("class", F.struct("of_class", "class")).alias("commonest"), F.count("*").alias("several")).where("several > 1").drop("several")
    early = materialise(early.join(commonest, ["head", "x"]), "met")
    side = lambda p: early.select("head", "x", "commonest", *[F.col(c).alias(f"{p}_{c}") for c in ("h", "class", "n", "size", "at")])
    left = side("l").where("l_class <> commonest").drop("commonest")
    shared = least(F.col("l_size") + F.col("r_size") - r * (F.col("l_n") + F.col("r_n")))
    once = (F.col("r_class") == F.col("commonest")) | (F.col("l_h") < F.col("r_h"))
    fits = (F.col("l_class") != F.col("r_class")) & once & (F.col("l_at") <= F.col("l_size") - shared + 1) & (F.col("r_at") <= F.col("r_size") - shared + 1)
    return left.join(side("r"), ["head", "x"]).where(fits).select(F.least("l_h", "r_h").alias("a"), F.greatest("l_h", "r_h").alias("b")).distinct()


def paragraph_links(docs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between distinct paragraph texts of enough similarity, from the compared pairs of all buckets."""
    banded = rows.where("kind = 0").select(F.explode("keys").alias("key"), "h")
    shared = materialise(banded.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"), "buckets")
    members = materialise(among(banded, shared).distinct(), "members")
    met = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    central = met.groupBy("h").agg(F.sum("n").alias("met"))
    # Heads are stored, so that the join on a hot key is one of two plain shuffles, which Spark splits.
    heads = materialise(members.join(central, "h").groupBy("key").agg(F.min_by("h", F.struct(-F.col("met"), F.col("h"))).alias("head")), "heads")
    wanted = materialise(members.select("h").distinct(), "wanted")
    shingles = materialise(_shingles_of(docs, rows, wanted, id_col, text_col), "shingles")
    stars = members.join(heads, "key").where("h <> head").select(F.col("h").alias("a"), F.col("head").alias("b")).distinct()
    stars = materialise(_similar(stars, shingles, similarity, unlike=True), "stars")

    # Members linked to a head or a leader are linked to each other by it; pairs of what is still apart are compared.
    led = _leaders(stars, similarity)
    first = materialise(stars.where("linked").select("a", "b").unionByName(led), "links")
    classes = materialise(connected_components(first).select(F.col("node").alias("h"), F.col("component").alias("class")), "classes")
    rest = materialise(_unlinked_pairs(stars, similarity, classes), "rest")
    links = classes.select(F.col("h").alias("a"), F.col("class").alias("b")).unionByName(_similar(rest, shingles, similarity).where("linked").select("a", "b"))
    links = materialise(links, "links")
    release(shared, members, heads, wanted, shingles, stars, led, first, classes, rest)
    return links


def _place(*at: str) -> Column:
    """The order of occurrences."""
    return F.struct("no_id", "doc_id", "t1", "t2", *at)


def _one_of_copies(rows: DataFrame, *columns: str) -> DataFrame:
    """Of rows of equal texts that of the least id."""
    own = F.min(F.struct("no_id", "doc_id")).alias("own")
    return rows.groupBy("t1", "t2", *columns).agg(own).select("t1", "t2", "own.no_id", "own.doc_id", *columns)


def _lines(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Paragraphs whose component two texts or more have."""
    named = connected_components(links).select(F.col("node").alias("h"), "component")
    whole = rows.where("kind = 0").select(*_OWNER, "first_word", "n_words", "h")
    texts = whole.groupBy("h").agg(F.min(_place("first_word")).alias("first"), F.min("t1").alias("lo"), F.max("t1").alias("hi"))
    texts = texts.join(named, "h", "left").where("component is not null or lo <> hi").withColumn("component", F.coalesce("component", "h"))
    texts = materialise(texts, "texts")
    shared = texts.groupBy("component").agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    shared = materialise(texts.select("h", "component").join(shared.select("component", "first"), "component"), "shared")
    found = _one_of_copies(among(whole.withColumn("key", F.col("h")), shared.select(F.col("h").alias("key"))), "first_word", "n_words", "h")
    lines = materialise(found.join(shared, "h").select(*_OWNER, "first_word", "n_words", "component", (_place("first_word") == F.col("first")).alias("keep")), "lines")
    release(texts, shared)
    return lines


_NONE = 0xFFFFFFFF


def _around(docs: DataFrame, found: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The found windows outside of removed paragraphs, with the REACH words before (the nearest first) and after each.

    Words of removed paragraphs and places beyond the text's ends are like no word.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.concatenate([REACH - 1 - np.arange(REACH), REACH + WINDOW + np.arange(REACH)])
        for batch in batches:
            nths, ats, hs, around = [], [], [], []
            for nth, (text, first, n, h, cut) in enumerate(zip(*[batch[c] for c in ("text", "first_word", "n_words", "h", "cut")], strict=True)):
                cut = cut.astype(bool)
                at, h = first[~cut], h[~cut]
                if not len(at):
                    continue
                words = _words(text)
                marks = np.full(len(words) + 2 * REACH, _NONE, np.uint32)
                inside = marks[REACH:-REACH]
                inside[:] = _mark(words) >> np.uint64(33)
                for x, k in zip(first[cut], n[cut], strict=True):
                    inside[x : x + k] = _NONE
                lost = np.concatenate([[0], np.cumsum(inside == _NONE)])
                stays = lost[at + WINDOW] == lost[at]
                at, h = at[stays], h[stays]
                nths.append(np.full(len(at), nth))
                ats.append(at)
                hs.append(h)
                around += [w.tobytes() for w in marks[at[:, None] + places]]
            if around:
                own = np.concatenate(nths)
                yield pd.DataFrame({c: batch[c].to_numpy()[own] for c in _OWNER} | {"first_word": np.concatenate(ats), "h": np.concatenate(hs), "words": around})

    with_window = found.select("t1", "t2").distinct()
    cuts = gone.join(with_window, ["t1", "t2"], "left_semi").select(*_OWNER, "first_word", "n_words", F.lit(0).cast("long").alias("h"), F.lit(True).alias("cut"))
    wanted = found.select(*_OWNER, "first_word", F.lit(WINDOW).alias("n_words"), "h", F.lit(False).alias("cut")).unionByName(cuts)
    return _read_again(docs, wanted, read, "t1 long, t2 long, no_id boolean, doc_id long, first_word int, h long, words binary", id_col, text_col)


def _reaches(around: DataFrame) -> DataFrame:
    """Rows (owner, h, start, end, keep): each window but its first occurrence as far as the words agree with the first's, and what of the first that meets.

    Where two texts agree on more than REACH words before or after a window, they share a chosen window there as well.
    """
    first = F.struct(*[F.col(c).alias(f"{c}0") for c in (*_OWNER, "first_word", "words")])
    heads = materialise(around.groupBy("h").agg(F.min_by(first, _place("first_word")).alias("head")).select("h", "head.*"), "heads")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch[c]), "<u4").reshape(-1, 2 * REACH) for c in ("words", "words0"))
            same = (a == b) & (a != _NONE)
            left, right = np.cumprod(same[:, :REACH], 1).sum(1), np.cumprod(same[:, REACH:], 1).sum(1)
            yield batch.drop(columns=["words", "words0"]).assign(left=left, right=right)

    schema = "t1 long, t2 long, no_id boolean, doc_id long, first_word int, h long, t10 long, t20 long, no_id0 boolean, doc_id0 long, first_word0 int, left int, right int"
    met = around.join(heads, "h").select(*_OWNER, "first_word", "h", "words", *[f"{c}0" for c in _OWNER], "first_word0", "words0").mapInPandas(read, schema)
    itself = F.struct(*_OWNER, "first_word") == F.struct(*[f"{c}0" for c in _OWNER], "first_word0")
    met = materialise(met.withColumn("keep", itself), "reaches")
    release(heads)
    others = met.where("not keep").select(*_OWNER, "h", (F.col("first_word") - F.col("left")).alias("start"), (F.col("first_word") + WINDOW + F.col("right")).alias("end"), F.lit(False).alias("keep"))
    own = [F.when(F.col("keep"), 0).otherwise(F.col(c)) for c in ("left", "right")]
    firsts = met.groupBy("h", *[f"{c}0" for c in _OWNER], "first_word0").agg(F.max(own[0]).alias("left"), F.max(own[1]).alias("right"))
    firsts = firsts.select(*[F.col(f"{c}0").alias(c) for c in _OWNER], "h", (F.col("first_word0") - F.col("left")).alias("start"), (F.col("first_word0") + WINDOW + F.col("right")).alias("end"), F.lit(True).alias("keep"))
    return others.unionByName(firsts)


def _joined(some: list[tuple[int, int, int]]) -> list[list]:
    """[start, end, windows] of (start, end, window) in order, those that overlap or touch joined."""
    out: list[list] = []
    for start, end, h in some:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].append(h)
        else:
            out.append([start, end, [h]])
    return out


def _own_spans(some: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, bool, list[int]]]:
    """(start, end, keep, windows) of one document: what is removed, and what is kept less what is removed.

    Windows to be kept of which nothing is left go with the removed span over them.
    """
    some.sort()
    gone, kept = (_joined([x[:3] for x in some if x[3] is k]) for k in (False, True))
    out, i = [], 0
    for start, end, hs in kept:
        at, over = start, []
        pieces = []
        while i < len(gone) and gone[i][1] <= start:
            i += 1
        k = i
        while k < len(gone) and gone[k][0] < end:
            g = gone[k]
            k += 1
            over.append(g)
            if g[0] > at:
                pieces.append((at, g[0]))
            at = max(at, g[1])
        if at < end:
            pieces.append((at, end))
        out += [(x, y, True, hs) for x, y in pieces]
        if not pieces:
            over[0][2].extend(hs)
    return out + [(x, y, False, hs) for x, y, hs in gone]


def _spans(reaches: DataFrame) -> DataFrame:
    """Rows (owner, first_word, n_words, keep, hs) of each text's spans, with the windows in them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *own, start, end, h, keep in zip(*[batch[c] for c in (*_OWNER, "start", "end", "h", "keep")], strict=True):
                for x, y, k, hs in _own_spans(list(zip(start.tolist(), end.tolist(), h.tolist(), keep.tolist(), strict=True))):
                    out.append((*own, x, y - x, k, hs))
            if out:
                yield pd.DataFrame(out, columns=[*_OWNER, "first_word", "n_words", "keep", "hs"])

    held = reaches.groupBy(*_OWNER).agg(F.collect_list(F.struct("start", "end", "h", "keep")).alias("w"))
    held = held.select(*_OWNER, *[F.col(f"w.{c}").alias(c) for c in ("start", "end", "h", "keep")])
    return held.mapInPandas(read, "t1 long, t2 long, no_id boolean, doc_id long, first_word int, n_words int, keep boolean, hs array<long>")


def _window_spans(docs: DataFrame, rows: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (owner, first_word, n_words, component, keep) of the spans of windows that several texts have."""
    windows = rows.where("kind = 1").select(*_OWNER, "first_word", "h")
    common = materialise(windows.groupBy("h").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo <> hi").select(F.col("h").alias("key")), "common")
    found = _one_of_copies(among(windows.withColumn("key", F.col("h")), common), "first_word", "h")
    found = materialise(found, "found")
    around = materialise(_around(docs, found, gone, id_col, text_col), "around")
    spans = materialise(_spans(_reaches(around)), "spans")
    named = connected_components(spans.select(F.get("hs", F.lit(0)).alias("a"), F.explode("hs").alias("b"))).select(F.col("node").alias("h"), "component")
    out = materialise(spans.withColumn("h", F.get("hs", F.lit(0))).join(named, "h").select(*_OWNER, "first_word", "n_words", "component", "keep"), "spans")
    release(common, found, around, spans)
    return out


def _copies(places: DataFrame, rows: DataFrame, min_words: int) -> DataFrame:
    """All rows of texts of at least `min_words` words that several rows have, as passages; the first stays."""
    texts = places.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min(_place("row")).alias("first")).where("n > 1").drop("n")
    sizes = rows.where((F.col("kind") == 2) & (F.col("n_words") >= min_words)).select("t1", "t2", "n_words").distinct()
    hot = materialise(texts.join(sizes, ["t1", "t2"]), "copies")
    near = among(places.withColumn("key", F.col("t1")), hot.select(F.col("t1").alias("key")), exact=False)
    return near.join(hot, ["t1", "t2"]).select(*_OWNER, F.lit(0).alias("first_word"), "n_words", F.col("t1").alias("component"), (_place("row") == F.col("first")).alias("keep"))


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence of a passage that two documents or more share.

    doc_id, text_hash (xxhash64 of the whole text), first_word (counted in the whole text from 0), n_words, kind, component_id,
    keep. Of the rows of one text (kind `text`) the first is kept; the other kinds speak of that row only. Of the paragraphs
    of a component (kind `paragraph`) the first is kept. Of the occurrences of each window outside of removed paragraphs the
    first is kept, and spans of others (kind `span`) are removed, so a removed word has an earlier place that stays.
    """
    places = materialise(_slim(docs, id_col, text_col).drop("text").withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = materialise(paragraphs(docs, min_words, id_col, text_col), "paragraphs")
    links = paragraph_links(docs, rows, similarity, id_col, text_col)
    lines = _lines(rows, links)
    spans = _window_spans(docs, rows, lines.where("not keep"), id_col, text_col)
    copies = materialise(_copies(places, rows, min_words), "copies")
    release(rows, places, links)
    one = lambda df, kind: df.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), F.col("t1").alias("text_hash"), "first_word", "n_words", F.lit(kind).alias("kind"), F.col("component").alias("component_id"), "keep")
    return one(lines, "paragraph").unionByName(one(spans, "span")).unionByName(one(copies, "text"))


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of passages that are not kept; lines left empty by that go, a text of which all goes is empty."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, cuts, strict=True):
            if text is None or some is None or not len(some):
                out.append(text)
                continue
            raw = text.encode()
            gone = np.zeros(len(raw.split()) + 1, bool)
            for c in some:
                gone[c["first_word"] : c["first_word"] + c["n_words"]] = True
            lines, at = [], 0
            for line in raw.split(b"\n"):
                words = line.split()
                lost = gone[at : at + len(words)]
                at += len(words)
                if not lost.any():
                    lines.append(line)
                elif not lost.all():
                    lines.append(b" ".join(w for w, x in zip(words, lost, strict=True) if not x))
            out.append(b"\n".join(lines).decode())
        return pd.Series(out, dtype=object)

    ready_workers(docs.sparkSession)
    whole = F.col("kind") == "text"
    own = passages.groupBy(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("text_hash").alias("t1")).agg(
        F.collect_list(F.when(~whole & ~F.col("keep"), F.struct("first_word", "n_words"))).alias("cuts"), F.max(whole & F.col("keep")).alias("stays"), F.max(whole & ~F.col("keep")).alias("goes")
    )
    rows = docs.select(F.struct(*docs.columns).alias("in"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t1"))
    met = rows.join(own, ["no_id", "doc_id", "t1"], "left")
    text = F.col("in").getField(text_col)
    several = F.coalesce(F.col("stays") & F.col("goes"), F.lit(False))
    alone = met.where(~several).select("in", F.when(F.col("goes"), "").otherwise(cut(text, F.col("cuts"))).alias("text"))
    # Rows of equal id and text are alike: one of them is the first.
    alike = materialise(met.where(several).withColumn("row", F.monotonically_increasing_id()), "alike")
    first = alike.groupBy("no_id", "doc_id", "t1").agg(F.min("row").alias("row"), F.lit(True).alias("is_first"))
    alike = alike.join(first, ["no_id", "doc_id", "t1", "row"], "left").select("in", F.when(F.col("is_first"), cut(text, F.col("cuts"))).otherwise("").alias("text"))
    return alone.unionByName(alike).select(*[(F.col("text") if c == text_col else F.col("in").getField(c)).alias(c) for c in docs.columns])
