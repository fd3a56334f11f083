"""Alignment of two tokenizers' tokens over bytes, by an associative algebra of fragments.

A fragment stands for the tokens of both sides that end in a range of bytes: an open
prefix up to the first offset where both sides end, closed groups, and an open
suffix. Two neighbours compose: the suffix of one and the prefix of the next become a
closed group. The composition is associative, so that a very long document is cut
into ranges of bytes, each range is a row of some task, and a tree of reductions
puts the document together again.

Neither tokenizer here makes a token across a single space between two other
characters (checked on the vocabularies), so that the text between two such spaces, a
unit, is encoded by itself, once for all of its repetitions in a batch. Where a
vocabulary has such tokens, a text is one unit. A unit is never cut for encoding;
ranges of bytes may end inside it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtag.llm.shared import saved, text_slices

#: Bytes of a range of a long text; fragments that one group composes; pairs of ids that are broadcast at most (about 40 bytes each).
CHUNK, FAN_IN, MOST_PAIRS = 1 << 18, 16, 4_000_000
#: Units, and characters of them, that a worker remembers from batch to batch.
MOST_UNITS, MOST_CHARS = 250_000, 6_000_000
#: Units that are encoded at once (a library's object for each is much larger than its ids), bytes of texts that are aligned at once.
BATCH, SLICE = 10_000, 1 << 20
_GAP = re.compile(r"(?<=\S) (?=\S)")  # Python's white space holds that of either tokenizer
_NONE = np.zeros(0, np.int64)


def _letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Lists:
    """Lists of numbers, appended to: those of list i are flat[start[i] : start[i + 1]]."""

    def __init__(self):
        self.flat, self.start = _NONE, np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of `which` one after the other, and their lengths."""
        first, lengths = self.start[which], self.start[which + 1] - self.start[which]
        ahead = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(first - ahead, lengths) + np.arange(lengths.sum())], lengths


class Units:
    """Both tokenizers in a worker, and the units that it has met: their ids, groups as text, and links with their number."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters, names = _letters(), [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.a_bytes = [bytes(letters[c] for c in t) if set(t) <= letters.keys() else t.encode() for t in names]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.b_n, self.n_pairs = len(pieces), len(names) * len(pieces)
        # neither makes a token with a space behind a character that is not white space
        self.separable = not any(re.search(r"\S ", t.decode(errors="replace")) for t in self.a_bytes) and not any(re.search(r"[^\s▁]▁", p) for p in pieces)
        self.forget(0)

    def forget(self, most: int = MOST_UNITS) -> None:
        """Forgets the units where they are more than most, or long."""
        if not most or len(self.texts) > most or self.chars > MOST_CHARS:
            self.known, self.texts, self.chars = {}, [], 0
            self.ids_a, self.ids_b, self.pairs, self.counts = Lists(), Lists(), Lists(), Lists()
            self.sizes, self.groups, self.good = _NONE, _NONE, np.zeros(0, bool)

    def split(self, text: str) -> list[str]:
        return _GAP.split(text) if self.separable else [text]

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each unit; new ones are encoded, and aligned as one text, in which every unit ends a group."""
        fresh = [u for u in dict.fromkeys(units) if u not in self.known]
        if fresh:
            self.known.update(zip(fresh, range(len(self.texts), len(self.texts) + len(fresh)), strict=True))
            self.chars += sum(map(len, fresh))
            for i in range(0, len(fresh), BATCH):
                self._add(fresh[i : i + BATCH])
        return np.fromiter((self.known[u] for u in units), np.int64, len(units))

    def _add(self, fresh: list[str]) -> None:
        raw = [(" " + u).encode() for u in fresh]
        sides = [x.ids for x in self.a.encode_batch_fast([" " + u for u in fresh], add_special_tokens=False)], self.b.encode(fresh, num_threads=1)
        sizes, good = np.array([len(r) for r in raw], np.int64), np.ones(len(fresh), bool)
        for side, table in zip(sides, (self.a_bytes, self.b_bytes), strict=True):
            parts = [b"".join([table[i] for i in x]) for x in side]
            if parts != raw:
                good &= [x == r for x, r in zip(parts, raw, strict=True)]
        if not good.all():
            sides = [[x if ok else [] for x, ok in zip(side, good, strict=True)] for side in sides]
        lengths = [np.array([len(x) for x in side], np.int64) for side in sides]
        flat = [np.array([*chain.from_iterable(side)], np.int64) for side in sides]
        stream = Open(flat[0], np.cumsum(self.a_sizes[flat[0]]), flat[1], np.cumsum(self.b_sizes[flat[1]]))
        stops, common = stream.stops()
        # a unit that is not good has no bytes here: the first of equal ends is that of a unit with bytes
        ends = np.cumsum(np.where(good, sizes, 0))
        owner = lambda x: np.searchsorted(ends, x)
        found, counts = np.unique(owner(stops) * self.n_pairs + stream.links(self.b_n, stops), return_counts=True)
        groups, texts = np.bincount(owner(common), minlength=len(fresh)), stream.texts(common)
        at = np.cumsum(groups) - groups
        self.texts += [";".join(texts[i : i + n]) for i, n in zip(at.tolist(), groups.tolist(), strict=True)]
        self.ids_a.add(flat[0], lengths[0])
        self.ids_b.add(flat[1], lengths[1])
        of = np.bincount(found // self.n_pairs, minlength=len(fresh))
        self.pairs.add(found % self.n_pairs, of)
        self.counts.add(counts, of)
        self.sizes, self.groups, self.good = np.concatenate([self.sizes, sizes]), np.concatenate([self.groups, groups]), np.concatenate([self.good, good])

    def stream(self, which: np.ndarray, start: int) -> Open:
        """The tokens of these units one after the other, from the byte start on."""
        a, b = self.ids_a.take(which)[0], self.ids_b.take(which)[0]
        return Open(a, start + np.cumsum(self.a_sizes[a]), b, start + np.cumsum(self.b_sizes[b]))


@functools.lru_cache(maxsize=2)
def units_of(a_file: str, b_file: str) -> Units:
    return Units(a_file, b_file)


class Open:
    """Tokens in a stretch of a text: ids and ends (bytes) of both sides."""

    __slots__ = ("a", "a_ends", "b", "b_ends")

    def __init__(self, a=_NONE, a_ends=_NONE, b=_NONE, b_ends=_NONE):
        self.a, self.a_ends, self.b, self.b_ends = a, a_ends, b, b_ends

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in self.__slots__))

    def between(self, low: int, high: int) -> Open:
        """The tokens that end in (low, high]."""
        (i, x), (j, y) = ((np.searchsorted(e, low, "right"), np.searchsorted(e, high, "right")) for e in (self.a_ends, self.b_ends))
        return Open(self.a[i:x], self.a_ends[i:x], self.b[j:y], self.b_ends[j:y])

    def stops(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a token of either side ends, and where tokens of both do."""
        both = np.concatenate([self.a_ends, self.b_ends])
        both.sort(kind="stable")  # two runs
        again = both[1:] == both[:-1]
        return both[np.concatenate([[True], ~again])[: len(both)]], both[1:][again]

    def links(self, b_n: int, stops: np.ndarray | None = None) -> np.ndarray:
        """a x b_n + b of all overlapping tokens of whole groups: one for each stretch between neighbouring ends (stops) of either side."""
        stops = self.stops()[0] if stops is None else stops
        return self.a[np.searchsorted(self.a_ends, stops)] * b_n + self.b[np.searchsorted(self.b_ends, stops)]

    def texts(self, ends: np.ndarray) -> list[str]:
        """The groups that end at ends, `a1,a2|b1` each."""
        a, b, i, j, out = [*map(str, self.a.tolist())], [*map(str, self.b.tolist())], 0, 0, []
        for x, y in zip(np.searchsorted(self.a_ends, ends, "right").tolist(), np.searchsorted(self.b_ends, ends, "right").tolist(), strict=True):
            out.append(f"{a[i] if x == i + 1 else ','.join(a[i:x])}|{b[j] if y == j + 1 else ','.join(b[j:y])}")
            i, j = x, y
        return out


def counted(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their counts."""
    found, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


class Fragment:
    """What a range of a text's bytes holds: an open prefix, closed groups, an open suffix.

    Where no offset ends tokens of both sides (cut is false) all tokens are in the
    prefix. Of the closed groups it has the text, the number, and the distinct links
    with their counts.
    """

    __slots__ = ("cut", "prefix", "text", "groups", "pairs", "counts", "suffix")

    def __init__(self, cut: bool, prefix: Open, text: str = "", groups: int = 0, pairs: np.ndarray = _NONE, counts: np.ndarray = _NONE, suffix: Open | None = None):
        self.cut, self.prefix, self.text, self.groups, self.pairs, self.counts = cut, prefix, text, groups, pairs, counts
        self.suffix = suffix or Open()

    @classmethod
    def of(cls, tokens: Open, b_n: int) -> Fragment:
        """The fragment of the tokens that end in a range."""
        common = tokens.stops()[1]
        if not len(common):
            return cls(False, tokens)
        closed = tokens.between(common[0], common[-1])
        links = closed.links(b_n)
        pairs, counts = counted([links], [np.ones(len(links), np.int64)])
        return cls(True, tokens.between(-1, common[0]), ";".join(closed.texts(common[1:])), len(common) - 1, pairs, counts, tokens.between(common[-1], np.iinfo(np.int64).max))

    def then(self, other: Fragment, b_n: int) -> Fragment:
        """The fragment of this range and the one behind it; associative."""
        if not self.cut:
            return Fragment(other.cut, self.prefix + other.prefix, other.text, other.groups, other.pairs, other.counts, other.suffix)
        if not other.cut:
            return Fragment(True, self.prefix, self.text, self.groups, self.pairs, self.counts, self.suffix + other.prefix)
        middle = self.suffix + other.prefix
        links = middle.links(b_n)
        pairs, counts = counted([self.pairs, links, other.pairs], [self.counts, np.ones(len(links), np.int64), other.counts])
        texts = [t for t in (self.text, *middle.texts(middle.a_ends[-1:]), other.text) if t]
        return Fragment(True, self.prefix, ";".join(texts), self.groups + 1 + other.groups, pairs, counts, other.suffix)

    def whole(self, b_n: int) -> Fragment:
        """This fragment as that of a whole text: a group begins at the first byte, so the prefix is closed too."""
        return Fragment(True, Open()).then(self, b_n)


def _ranges(units: Units, text: str, chunk: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, low, high, part) of ranges of about chunk bytes of a space and the text.

    part is the units that the bytes from low to high touch, start the offset of the
    first. A range ends inside a unit, unless the unit is longer than a range: then behind it.
    """
    parts = units.split(text)
    ends = np.cumsum([len(u.encode()) + 1 for u in parts])
    low, total = 0, int(ends[-1])
    while low < total:
        high = min(low + chunk, total)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high)
        if ends[last] - (ends[last - 1] if last else 0) > chunk:
            high = int(ends[last])
        yield int(ends[first - 1]) if first else 0, low, high, " ".join(parts[first : last + 1])
        low = high


def _nested(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, counts array<bigint>"
_OPEN = "struct<a:array<bigint>,a_ends:array<bigint>,b:array<bigint>,b_ends:array<bigint>>"
_FRAGMENT = f"good boolean, n_a long, n_b long, cut boolean, prefix {_OPEN}, text string, n_groups long, pairs array<bigint>, counts array<bigint>, suffix {_OPEN}"

_FRAGMENT_COLUMNS = ("good", "n_a", "n_b", "cut", "prefix", "text", "n_groups", "pairs", "counts", "suffix")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _short(units: Units, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """The columns of _COUNTS for a batch of texts, from the counts of their units."""
    parts = [units.split(t) if t else [] for t in batch.column("text").to_pylist()]
    lengths = np.array([len(p) for p in parts], np.int64)
    which, doc, n = units.numbers([u for p in parts for u in p]), np.repeat(np.arange(len(parts)), lengths), len(parts)
    good = (np.bincount(doc, weights=~units.good[which], minlength=n) == 0) & (lengths > 0)
    kept = good[doc]
    which, doc, lengths = which[kept], doc[kept], np.where(good, lengths, 0)
    totals = [np.bincount(doc, weights=x[which], minlength=n).astype(np.int64) for x in (np.diff(units.ids_a.start), np.diff(units.ids_b.start), units.groups)]
    met, times = np.unique(doc * max(1, len(units.texts)) + which, return_counts=True)  # units of a document with their number
    met_doc, met_unit = np.divmod(met, max(1, len(units.texts)))
    (pairs, sizes), (counts, _) = units.pairs.take(met_unit), units.counts.take(met_unit)
    found, sums = counted([np.repeat(met_doc, sizes) * units.n_pairs + pairs], [np.repeat(times, sizes) * counts])
    owner = found // units.n_pairs
    of, ends = np.bincount(owner, minlength=n), np.cumsum(lengths)
    digests = [_digest(";".join([units.texts[i] for i in which[e - k : e].tolist()])) if k else "" for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
    links = np.bincount(owner, weights=sums, minlength=n).astype(np.int64)
    columns = [*map(pa.array, (*totals, links)), pa.array(digests, pa.string()), _nested(found % units.n_pairs, of), _nested(sums, of)]
    return dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"), columns, strict=True))


def _opened(x: Open) -> dict:
    return {n: getattr(x, n) for n in Open.__slots__}


def _row(good: bool, n_a: int, n_b: int, f: Fragment) -> tuple:
    return good, n_a, n_b, f.cut, _opened(f.prefix), f.text, f.groups, f.pairs, f.counts, _opened(f.suffix)


def _fragment(r) -> Fragment:
    array = lambda x: np.array(x, np.int64)
    sides = [Open(*(array(x[n]) for n in Open.__slots__)) for x in (r.prefix, r.suffix)]
    return Fragment(bool(r.cut), sides[0], r.text, int(r.n_groups), array(r.pairs), array(r.counts), sides[1])


def aligned(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts) for each row of docs.

    a_file is a byte-level vocabulary (tokenizers), b_file a model of pieces with byte
    fallback (sentencepiece); both are read on every executor. A text is encoded with a
    space before it, without special tokens. Groups end where tokens of both sides
    do; groups_sha256 is of `a1,a2|b1;a3|b2,b3`, ids in order. pairs are the distinct
    links, a x (number of pieces) + b, counts how often they occur in the text, n_links their sum.

    A null or empty text, and one whose bytes a side does not give back, has no
    tokens: zeros, an empty string, empty arrays. Texts of chunk bytes or more are cut into
    ranges, aligned in tasks of their own, and put together FAN_IN at a time. Rows with
    null or repeated ids stay rows of their own. An empty table gives no rows; other
    columns are ignored.
    """
    rows, columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id", "key", "k", *_FRAGMENT_COLUMNS]
    kind, is_long = rows.schema["id"].dataType.simpleString(), F.coalesce(F.octet_length("text") >= chunk, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(a_file, b_file)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_pydict({"id": part.column("id")} | _short(units, part))
                units.forget()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(a_file, b_file)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for i, key, text in zip(*(part.column(c) for c in ("id", "key", "text")), strict=True):
                    for k, (start, low, high, piece) in enumerate(_ranges(units, text.as_py(), chunk)):
                        yield pa.RecordBatch.from_pydict({"id": pa.array([i.as_py()], part.schema.field("id").type), "key": pa.array([key.as_py()]), "k": pa.array([k]), "start": pa.array([start]), "low": pa.array([low]), "high": pa.array([high]), "text": pa.array([piece], pa.string())})

    def fragments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = units_of(a_file, b_file)
        for frame in frames:
            for r in frame.itertuples(index=False):
                which = units.numbers(units.split(r.text))
                good, f, n_a, n_b = bool(units.good[which].all()), Fragment(False, Open()), 0, 0
                if good:
                    tokens = units.stream(which, r.start).between(r.low, r.high)
                    f, n_a, n_b = Fragment.of(tokens, units.b_n), len(tokens.a), len(tokens.b)
                yield pd.DataFrame([(r.id, r.key, r.k, *_row(good, n_a, n_b, f))], columns=columns)
                units.forget()

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        units, parts = units_of(a_file, b_file), [*group.sort_values("k").itertuples(index=False)]
        f, good = Fragment(False, Open()), all(r.good for r in parts)
        for r in parts if good else ():
            f = f.then(_fragment(r), units.b_n)
        return pd.DataFrame([(parts[0].id, parts[0].key, parts[0].k // FAN_IN, *_row(good, sum(r.n_a for r in parts), sum(r.n_b for r in parts), f))], columns=columns)

    def closed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = units_of(a_file, b_file)
        for frame in frames:
            for r in frame.itertuples(index=False):
                f = _fragment(r).whole(units.b_n) if r.good else Fragment(True, Open())
                yield pd.DataFrame([(r.id, r.n_a * r.good, r.n_b * r.good, f.groups, f.counts.sum(), _digest(f.text) if r.good else "", f.pairs, f.counts)], columns=["id", *(c.split()[0] for c in _COUNTS.split(", "))])

    found = rows.where(~is_long).mapInArrow(short, f"id {kind}, {_COUNTS}")
    large = rows.where(is_long).withColumn("key", F.monotonically_increasing_id())
    parts = saved(large.mapInArrow(pieces, f"id {kind}, key long, k long, start long, low long, high long, text string"), "ranges")
    n, most = parts.agg(F.count("*"), F.max("k")).first()
    if n:
        schema = f"id {kind}, key long, k long, {_FRAGMENT}"
        parts = saved(parts.repartition(1 + n // 4, "key", "k").mapInPandas(fragments, schema), "fragments")
        while most:
            parts, most = saved(parts.groupBy("key", F.floor(F.col("k") / FAN_IN)).applyInPandas(composed, schema), "fragments"), most // FAN_IN
        found = found.unionByName(parts.mapInPandas(closed, f"id {kind}, {_COUNTS}"))
    return found.withColumnRenamed("id", id_col)


def pair_statistics(rows: DataFrame, b_n: int) -> DataFrame:
    """(pair, n, best): the rows whose distinct pairs hold it, and whether no pair of the same a is in more.

    Counted before the shuffle; an id has at most b_n partners.
    """
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    own = Window.partitionBy(F.floor(F.col("pair") / b_n))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def links(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs; see aligned().

    The count of a pair of ids is the number of documents that hold it linked. n_best are
    the links of a document whose count is the highest of their a (ties included), count_sum
    the counts of all its links. The statistics of pairs do not grow with the rows once the
    vocabularies are met; up to most_pairs of them are broadcast, more are joined by
    shuffles, which Spark splits where a pair is frequent.
    """
    rows = saved(aligned(docs, a_file, b_file, id_col, text_col, chunk), "aligned")
    stats = saved(pair_statistics(rows, _pieces(b_file)), "pairs")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    known = F.broadcast(stats) if stats.count() <= most_pairs else stats.hint("merge")
    each = rows.select("_row", F.inline(F.arrays_zip("pairs", "counts"))).select("_row", F.col("pairs").alias("pair"), "counts")
    sums = each.join(known, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("n_best"), F.sum(F.col("counts") * F.col("n")).alias("count_sum"))
    found = rows.drop("pairs", "counts").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _pieces(b_file: str) -> int:
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=b_file))
