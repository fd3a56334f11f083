"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union by components.

A signature slot keeps the least value rank + fraction over the shingles of a
document; each shingle visits the slots in the order of its own pseudo-random
permutation, so that its ranks in the slots are all different (correlated), which
lowers the variance against independent hash functions. A document stops as soon
as no shingle of the next rank can lower any slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtag.llm.components import components
from loomtag.llm.shared import hashed_words, mix64, row_slices, saved, text_slices

#: Slots of a signature: a prime, so that (start + rank * step) mod SLOTS is a permutation of them.
SLOTS = 241
#: 40 bands of 6 slots: a pair at 0.8 shares no band with probability (1 - 0.8^6)^40 < 1e-5.
BANDS, ROWS = 40, 6
#: 64-bit words of a set's parity bitmap.
PARITY = 32
#: Sets of up to so many shingles also share keys made of all of them, or of all but one.
TINY = 9
#: Bytes of texts and elements of sets that a worker holds arrays of at once, sets whose bitmaps it counts at once.
SLICE_BYTES, SLICE_ELEMENTS, SLICE_SETS = 1 << 20, 1 << 18, 512
#: Bits of the table of shingle frequencies, rows of a shingle that one task compares.
SKETCH_BITS, TOKEN_ROWS = 20, 20_000
_STEP, _START, _RANK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct `size`-word shingles, sorted within each text, and the owner of each.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    hashes, counts = hashed_words(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    out_h, out_o = [], []
    for n in range(1, size + 1):
        at = np.flatnonzero(counts == n) if n < size else np.flatnonzero(counts >= size)
        if n < size:
            first = ends[at] - n
            own = at
        else:
            first = np.flatnonzero(np.arange(len(hashes)) + size <= ends[owner]) if len(hashes) else np.zeros(0, np.int64)
            own = owner[first]
        acc = np.full(len(first), n, np.uint64)
        for j in range(n):
            acc = mix64(acc * _START + hashes[first + j])
        out_h.append(acc)
        out_o.append(own)
    h, o = np.concatenate(out_h), np.concatenate(out_o)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def super_minhash(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n, SLOTS) of n sets given as (element hash, owner); a slot holds rank << 48 | fraction."""
    sig = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    slot = (mix64(h ^ _START) % np.uint64(SLOTS)).astype(np.int64)
    step = (mix64(h ^ _STEP) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    base, owner = owner.astype(np.int64) * SLOTS, owner.astype(np.int64)
    for rank in range(SLOTS):
        if not len(h):
            break
        value = (mix64(h + np.uint64(rank * int(_RANK) % 2**64)) >> np.uint64(16)) | np.uint64(rank << 48)
        np.minimum.at(sig, base + slot, value)
        slot = (slot + step) % SLOTS
        if rank < 8 or rank % 4 == 0:
            docs = np.unique(owner)
            late = (sig.reshape(n, SLOTS)[docs].max(axis=1) >> np.uint64(48)) <= np.uint64(rank)
            if late.any():
                done = np.zeros(n, bool)
                done[docs[late]] = True
                on = ~done[owner]
                h, slot, step, base, owner = h[on], slot[on], step[on], base[on], owner[on]
    return sig.reshape(n, SLOTS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys; the number of the band is part of the key."""
    parts = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        acc = mix64(acc * _START + parts[:, :, j])
    return acc


def tiny_keys(h: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of small sets given as element hashes, one set after the other, n of each: the set, and the set without any one element.

    Small sets that meet the similarity differ by one element on either side at
    most, so they share a key; signatures of few elements are less independent than
    their bands assume.
    """
    least, first = -(-percent // (100 - percent)), np.cumsum(n) - n
    at = np.flatnonzero((n >= least) & (n <= TINY))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    v = mix64(h ^ _STEP)
    total = np.array([v[i : i + k].sum() for i, k in zip(first[at], n[at], strict=True)], np.uint64)
    owners, keys = [at], [total]
    for j in range(TINY):
        some = (n[at] > j) & (n[at] > least)
        owners.append(at[some])
        keys.append(total[some] - v[first[at[some]] + j])
    return np.concatenate(owners), mix64(np.concatenate(keys) ^ _RANK)


def _signed(size: int, percent: int):
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                h, o = shingle_sets(part.column("text"), size)
                m = part.num_rows
                n = np.bincount(o, minlength=m).astype(np.int64)
                keys = []
                for salt in (_STEP, _RANK):  # order does not matter to a sum: one key for equal sets
                    total, with_any = np.zeros(m, np.uint64), np.flatnonzero(n)
                    if len(with_any):
                        total[with_any] = np.add.reduceat(mix64(h ^ salt), (np.cumsum(n) - n)[with_any])
                    keys.append(pa.array(total.view(np.int64), mask=n == 0))
                whose, more = tiny_keys(h, n, percent)
                whose = np.concatenate([np.repeat(np.flatnonzero(n), BANDS), whose])
                bands = np.concatenate([band_keys(super_minhash(h, o, m))[n > 0].ravel(), more])[np.argsort(whose, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=m))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), *keys, pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.view(np.int64)))], schema=schema)

    return run


def parity_bits(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY) words; a bit is set if an odd number of elements falls on it.

    Two sets differ in at least as many elements as their bitmaps in bits, which
    bounds the intersection from above.
    """
    width, out, ends = PARITY * 64, [np.zeros((0, PARITY), np.int64)], np.searchsorted(owner, np.arange(0, n + SLICE_SETS, SLICE_SETS))
    for i, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        first, m = i * SLICE_SETS, min(SLICE_SETS, n - i * SLICE_SETS)
        at = (owner[x:y].astype(np.int64) - first) * width + (mix64(h[x:y] ^ _RANK) % np.uint64(width)).astype(np.int64)
        odd = np.bincount(at, minlength=m * width).astype(np.uint8) & 1
        out.append(np.packbits(odd.reshape(m, width), axis=1).view(np.int64))
    return np.concatenate(out)


def _full_sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                h, o = shingle_sets(part.column("text"), size)
                n = np.bincount(o, minlength=part.num_rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
                bits = pa.array(list(parity_bits(h, o, part.num_rows)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), lists, bits], schema=schema)

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets meet the similarity."""
    a = sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("hashes").alias("hu"))
    b = sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("hashes").alias("hv"))
    both = F.size(F.array_intersect("hu", "hv"))
    return (
        pairs.join(a, "u").join(b, "v")
        .select("u", "v", "nu", "nv", both.alias("both"))
        .where(F.col("both") * 100 >= (F.col("nu") + F.col("nv") - F.col("both")) * percent)
        .select("u", "v")
    )


def _may_meet(percent: int):
    """Whether (n, bits) and lead's can belong to sets of that similarity: both <= (n + n' - differing bits) / 2."""
    differ = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("lead.bits", F.lit(k)))) for k in range(PARITY)), F.lit(0))
    total = F.col("n") + F.col("lead.n")
    return (total - differ) * (100 + percent) >= total * (2 * percent)


def _sketched(sets: DataFrame) -> np.ndarray:
    """For each of 2^SKETCH_BITS ranges of shingle hashes the logarithm of how many of all sets' shingles lie in it: one byte each, whatever the corpus."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for h in (part.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64) for batch in batches for part in row_slices(batch, pc.list_value_length(batch.column("hashes")).to_numpy(zero_copy_only=False), SLICE_ELEMENTS)):
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["at", "n"])

    counts = sets.select("hashes").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    out[counts.column("at").to_numpy()] = 4 * np.log2(1.0 + counts.column("n").to_numpy())
    return out


def prefixes(h: np.ndarray, n: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, element, place, indexed): of each set the first elements in the order of rarity that a similar set must share one of.

    A set that meets the similarity with one of at least its size shares an element
    of its `indexed` prefix that lies in the other's whole prefix.
    """
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, often[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], owner))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    probe, index = n - -(-n * percent // 100) + 1, n - -(-n * 2 * percent // (100 + percent)) + 1
    keep = place < probe[owner]
    return owner[keep], h[order][keep], place[keep], (place < index[owner])[keep]


def _rare_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of sets in different components of apart (rep, comp) that may meet the similarity; none that does is missing.

    Sets meet on their rarest shingles alone. What many documents share, such as a
    template around their own words, comes last in the order of rarity, so documents
    that share no more than that never meet. The largest component of a shingle is
    not compared with itself, and a shingle with many rows is dealt to many tasks.
    """
    often = _sketched(sets)
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("comp", pa.int64()), ("place", pa.int64()), ("indexed", pa.bool_())])

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, batch.column("n").to_numpy(), SLICE_ELEMENTS):
                n = part.column("n").to_numpy()
                h = part.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner, token, place, indexed = prefixes(h, n, often, percent)
                ids, comps = part.column("id").to_numpy(), part.column("comp").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), ids[owner], n[owner], comps[owner], place, indexed)], schema=schema)

    mine = sets.join(apart.select(F.col("rep").alias("id"), "comp"), "id").select("id", "n", "comp", "hashes")
    rows = saved(mine.mapInArrow(run, "token long, id long, n long, comp long, place long, indexed boolean"), "prefixes")
    groups = rows.groupBy("token", "comp").agg(F.count("*").alias("c"), F.bool_or("indexed").alias("i")).groupBy("token")
    groups = groups.agg(F.max_by("comp", "c").alias("most"), F.sum("c").alias("rows"), F.count("*").alias("comps"), F.bool_or("i").alias("i")).where("comps > 1 AND i")
    met = rows.join(groups.select("token", "most", F.ceil(F.col("rows") / TOKEN_ROWS).alias("parts")), "token")
    one = F.struct("id", "n", "comp", "place", "indexed")
    left = met.where("comp <> most").select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), one.alias("a"))
    right = met.select("token", F.pmod(F.xxhash64("id"), "parts").alias("part"), one.alias("b"))

    def ahead(a: str, b: str):
        return ((F.col(f"{a}.n") < F.col(f"{b}.n")) | ((F.col(f"{a}.n") == F.col(f"{b}.n")) & (F.col(f"{a}.id") < F.col(f"{b}.id")))) & F.col(f"{a}.indexed") & (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent)

    # of the first element that two sets share, what follows it bounds the intersection
    room = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    pairs = left.join(right, ["token", "part"]).where((F.col("a.comp") != F.col("b.comp")) & room & (ahead("a", "b") | ahead("b", "a")))
    return pairs.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, star_rounds: int = 3) -> DataFrame:
    """One row (id_col, n_shingles, component_id, kept) for each row of docs.

    Documents are linked where the sets of their `shingle`-word shingles have a
    Jaccard similarity of percent / 100 or more; component_id is the least id
    reachable over links and kept says that the row has that id.

    Equal sets collapse to one representative first. Within a bucket (equal band)
    the members are verified against a leader, for `star_rounds` rounds with another
    leader each, so that a large group of near copies joins up in a number of
    comparisons linear in its size. What is then still apart within a bucket meets on
    its rarest shingles and is verified by bitmaps and by the full sets, so no link
    that a shared band shows is lost, and documents that share a template but are no
    near copies cost nothing more.

    Texts that are null or have no words have an empty set and are linked with
    nothing; a very long text has the set of all its shingles. Rows with a null id
    are linked with nothing, keep a null component_id and are kept. Rows that repeat
    an id are one document. Of a group whose texts tie the least id stays. An empty
    table gives no rows; columns besides the two named are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = saved(source.mapInArrow(_signed(shingle, percent), "id long, k1 long, k2 long, n long, bands array<long>"), "signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = saved(classes, "classes")  # written, so that the join of all copies with their class is one that Spark can split
    slots = classes.select("rep", "n", F.explode(F.array_distinct("bands")).alias("band"))
    shared = slots.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    members = saved(slots.join(shared, "band").select("band", "rep", "n"), "buckets")
    involved = members.select(F.col("rep").alias("id")).distinct()
    sets = saved(
        source.where("id IS NOT NULL").join(involved, "id", "left_semi")
        .mapInArrow(_full_sets(shingle), "id long, n long, hashes array<long>, bits array<long>"),
        "sets",
    )

    near = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    a, b = sets.select(F.col("id").alias("u"), "n", "bits"), sets.select(F.col("id").alias("v"), F.struct("n", "bits").alias("lead"))
    placed, labels = members.withColumn("comp", F.col("rep")), None
    for turn in range(star_rounds + 1):
        lead = F.struct((F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))).alias("o"), "rep", "n", "comp")
        apart = placed.groupBy("band").agg(F.min(lead).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        if turn < star_rounds:
            met = placed.join(apart.select("band", "lead"), "band").where(F.col("comp") != F.col("lead.comp")).where(near)
            pairs = met.select(F.least("rep", "lead.rep").alias("u"), F.greatest("rep", "lead.rep").alias("v"))
        else:
            rest = saved(placed.join(apart.select("band"), "band", "left_semi").select("rep", "comp").distinct(), "apart")
            if rest.isEmpty():
                break
            pairs = _rare_pairs(rest, sets, percent)
        # the bitmaps are a small part of the full sets
        pairs = pairs.distinct().join(a, "u").join(b, "v").where(_may_meet(percent)).select("u", "v")
        pairs = saved(pairs, "pairs")
        if pairs.isEmpty():
            if apart.isEmpty():
                break
            continue
        links = _links(pairs, sets, percent)
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v")))
        labels = components(links)
        named = labels.select(F.col("node").alias("rep"), F.col("root").alias("comp"))
        placed = members.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    out = signed.select("id", "k1", "k2", "n").join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left")
    out = out.withColumn("rep", F.when(F.col("id").isNull(), None).otherwise(F.coalesce("rep", "id")))
    if labels is not None:
        out = out.join(labels.select(F.col("node").alias("rep"), F.col("root").alias("comp")), "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    out = out.withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near duplicates: of each group the document with the least id stays, with all its columns.

    Rows that repeat an id count once (which of them stays is left open); rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.where(f"kept AND {id_col} IS NOT NULL").select(id_col).distinct()
    return docs.join(keep, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
