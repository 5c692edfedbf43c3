"""SimHash near-duplicates by covering locality-sensitive hashing.

A map from the 64 bit positions to vectors of radius + 1 bits gives 2^(radius+1) - 1 masks, one for each non-zero
vector v: the mask holds the positions whose vector has an odd inner product with v. For any `radius` positions some
v is orthogonal to all their vectors, so two fingerprints that differ in at most `radius` bits agree on some mask
and meet in that table: no pair is missed.

Fingerprints that meet in a bucket of a table are compared there, pair by pair, where the bucket is small. The members
of crowded buckets are resolved exactly and in linear size: for radius 2, each gives a row for itself and for each of
its 64 one-bit neighbours; fingerprints that share such a centre all lie within two bits of each other, and any two
within two bits share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, fresh, stored

BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of the whole text, as an unsigned integer; no word gives 0, fewer than `words` one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not parts:
        return 0
    if len(parts) < words:
        shingles = iter([b" ".join(parts)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
        n = len(parts) - words + 1
    digest, counts, left = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), n
    while left:
        size = min(left, _CHUNK)
        h = np.fromiter((digest(next(shingles), seed) for _ in range(size)), np.uint64, size)
        counts += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= size
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) for every row of docs; fp holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(words, seed), f"id {kind}, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks such that any two 64-bit values within `radius` bits agree on one of them at least."""
    width = radius + 1
    vectors = np.resize(np.arange(1, 1 << width), BITS)  # each non-zero vector about equally often
    np.random.default_rng(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (int(m) & v).bit_count() % 2) for v in range(1, 1 << width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: A bucket or group of more members than this is never compared pair by pair.
CROWD = 16


def bucketed(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, t, key, m): the fingerprints of every bucket of the covering tables that holds more than one, m being how many."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    # Written first, so that the join is of two plain exchanges, which a common bucket may split.
    met = checkpointed(rows.groupBy("t", "key").agg(F.count("*").alias("m")).filter("m > 1"))
    return checkpointed(rows.join(met, ["t", "key"]).select("fp", "t", "key", "m"))


def links(fps: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) over distinct fingerprints whose components are those of "differs in at most `radius` bits".

    radius is 1 or 2. Pairs are compared within the buckets of the covering tables that hold at most `crowd`. The
    members of larger ones meet in groups that share a centre: there every pair is a true link and the edges go to the
    smallest member, so a group of m gives m - 1 edges and the m^2 pairs are never made.
    """
    if radius not in (1, 2):
        raise ValueError("centres resolve a radius of 1 or 2")
    held = bucketed(fps, radius)
    few = held.filter(F.col("m") <= crowd)
    pairs = few.join(few.select(F.col("fp").alias("v"), "t", "key"), ["t", "key"]).filter("fp > v")
    near = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius).select(F.col("fp").alias("u"), "v")
    many = checkpointed(held.filter(F.col("m") > crowd).select("fp").distinct())
    if many.isEmpty():
        return near.distinct()
    if radius == 2:
        centres = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])).alias("c"))
    else:  # within one bit: equal after clearing the differing bit
        masked = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ (1 << i)))).alias("key")) for i in range(BITS)]
        centres = many.select("fp", F.explode(F.array(*masked)).alias("c"))
    groups = checkpointed(centres.groupBy("c").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("c", "low"))
    starred = centres.join(groups, "c").filter("fp > low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return near.unionByName(starred).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, class_size (documents in the component).

    component_id is the smallest id reachable over links of at most `radius` differing bits. Null, empty and
    word-free texts have the fingerprint zero and link like any other. Rows that repeat an id share its class. A
    null id takes part; it is a component's id only where the component has no other. Other columns are ignored.
    """
    ledger = checkpointed(fingerprints(docs, id_col, text_col, words, seed))
    fps = checkpointed(ledger.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    linked = checkpointed(components(links(fps, radius)))
    named = checkpointed(fps.join(linked, fps.fp == linked.node, "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component")))
    whole = checkpointed(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n").alias("class_size")))
    classes = checkpointed(named.join(whole, "component").select("fp", "component_id", "class_size"))
    out = ledger.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


# --- near-duplicates beyond the covering radius ------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of all shingles of the whole text in order; fewer words than `words` are one shingle, none is none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n = max(len(parts) - words + 1, 1)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else iter([b" ".join(parts)])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in shingles), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """The SimHash over shingle hashes, repeats included, as an unsigned integer; none gives 0."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        h = hashes[lo : lo + _CHUNK]
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


#: MinHash bands: a pair of Jaccard similarity s agrees on none of them with probability (1 - s^ROWS)^BANDS, 1.3e-7 at 0.8.
ROWS, BANDS = 5, 40
_MIN = _mix(np.arange(101, 101 + ROWS * BANDS, dtype=np.uint64)) | np.uint64(1)
_BAND = _mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys over ROWS MinHashes each of a set of shingle hashes; an empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    low = np.full(ROWS * BANDS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(shingles), 128):
        part = shingles[lo : lo + 128]
        np.minimum(low, np.multiply.outer(part, _MIN).min(axis=0), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = _mix(keys ^ row) * _BAND
    return keys


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, n, keys = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), []
            for i, t in enumerate(b.column(2)):
                h = shingle_hashes(t.as_py(), words)
                fps[i] = majority_bits(h)
                h = np.unique(h)
                n[i] = len(h)
                keys.append(bands(h).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(n), pa.array(keys, pa.list_(pa.int64()))], names=["id", "t", "fp", "n", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(1).slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(some, pa.binary())], names=["key", "shingles"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, raw in zip(b.column(0).to_pylist(), b.column(1)):
            h = np.frombuffer(raw.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key, np.int64)), pa.array(np.full(len(h), len(h), np.int64)), pa.array(h)], names=["key", "n", "g"])


#: The ratio of a class of sizes to the next in the search by rarest shingles.
_SIZES = 1.1


class _Search:
    """Links by shingles, sought among the groups of keys that agree on a band, on top of links that are known."""

    def __init__(self, keys: DataFrame, texts, known: DataFrame, words: int, similarity: float, crowd: int):
        self.texts, self.known, self.words, self.similarity, self.crowd = texts, known, words, similarity, crowd
        self.found = self.sets = None
        held = keys.select("key", "n", F.posexplode("bands").alias("last", "g"))
        several = checkpointed(held.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select("g"))
        self.held = checkpointed(held.join(several, "g").select("key", "n", "last", "g"))

    def mixed(self, held: DataFrame) -> DataFrame:
        """The rows of groups whose members are in different components so far, with component and group size."""
        placed = held.withColumn("component", F.col("key"))
        if self.found is not None:
            placed = checkpointed(held.join(self.found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
        low = F.min(F.struct("key", "n", "component")).alias("low")
        groups = checkpointed(placed.groupBy("g").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1"), low).filter("c0 < c1").select("g", "m", "low"))
        return checkpointed(placed.join(groups, "g"))

    def compare(self, pairs: DataFrame) -> None:
        """Verify pairs(u, nu, v, nv) by their whole shingle sets and bring the components up to date."""
        sized = F.least("nu", "nv") >= self.similarity * F.greatest("nu", "nv") - 1e-9
        some = checkpointed(pairs.filter(sized).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        links = self.known if self.found is None else self.found.select(F.col("node").alias("u"), F.col("component").alias("v")).filter("u != v")
        if some.isEmpty():
            close = None
        else:
            if self.sets is None:
                self.sets = stored(self.texts(self.held.select("key").distinct()).mapInArrow(_sets(self.words), "key long, shingles binary"), "shingles")
            whole = some.join(self.sets.toDF("u", "a"), "u").join(self.sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
            close = checkpointed(whole.mapInArrow(_similar(self.similarity), "u long, v long"))
            links = links.unionByName(close)
        if self.found is None or (close is not None and not close.isEmpty()):
            self.found = checkpointed(components(links))

    def pairs(self, rows: DataFrame) -> DataFrame:
        """All pairs of different components in the groups."""
        side = lambda x: rows.select("g", F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"))
        return side("u").join(side("v"), "g").filter("cu > cv").select("u", "nu", "v", "nv")

    def placed_pairs(self, rows: DataFrame) -> DataFrame:
        """The pairs of a smaller and a larger text of different components in the groups of `rarest` that the places of the
        shared shingle leave enough room: at the first shingle that two similar sets share, they do.

        The members of a group's largest component do not meet each other, so of what the join makes a third at least
        are pairs of different components, however large a family of copies is."""
        sizes = rows.groupBy("g", "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy("g").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
        known = rows.join(main, "g").withColumn("inside", F.col("component") == F.col("main"))
        side = lambda x: [F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("place").alias(f"p{x}")]
        large = known.filter("not small").select("g", "inside", *side("u"))
        meets = F.explode(F.when(F.col("inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False))))
        small = known.filter("small").select("g", meets.alias("inside"), *side("v"))
        share = self.similarity / (1 + self.similarity)
        room = 1 + F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) >= F.lit(share) * (F.col("nu") + F.col("nv")) - 1e-9
        both = small.join(large, ["g", "inside"]).filter(room & F.expr("cu != cv AND (nv < nu OR (nv = nu AND v < u))"))
        return both.select("u", "nu", "v", "nv")

    def stars(self, held: DataFrame) -> None:
        rows = self.mixed(held).filter("component != low.component")
        self.compare(rows.select(F.col("key").alias("u"), F.col("n").alias("nu"), F.col("low.key").alias("v"), F.col("low.n").alias("nv")))

    def rarest(self, keys: DataFrame) -> DataFrame:
        """(key, n, g, place, small): for each key as many of its shingles, the rarest among all of `keys`, as it takes for any
        two of the similarity sought to share one: two sets that share none of them differ in too many others.

        A group is a shingle and a class of sizes. A key is there as the larger of two texts in the class of its own size, and as
        the smaller one in each class of the larger sizes that its place leaves enough room. The smaller text's places are
        fewer, a ninth of its shingles at 0.8. Groups without both a smaller and a larger text are left out, so texts
        around a passage that is too short to make any two of them similar do not meet."""
        every = checkpointed(self.sets.join(keys, "key", "left_semi").mapInArrow(_exploded, "key long, n long, g long"))
        often = checkpointed(every.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"))
        met = every.join(often, "g")
        alone = F.col("n") - F.count("*").over(Window.partitionBy("key"))  # shingles of no other key come first
        place = F.row_number().over(Window.partitionBy("key").orderBy("m", "g"))
        most = F.col("n") - F.ceil(F.lit(self.similarity) * F.col("n") - 1e-9) + 1
        first = met.withColumn("place", place + alone).filter(F.col("place") <= most)
        # The largest partner's size, by the place and by the similarity.
        share = self.similarity / (1 + self.similarity)
        reach = F.least((1 + F.col("n") - F.col("place")) / F.lit(share) - F.col("n"), F.col("n") / F.lit(self.similarity)) + 1e-6
        size = lambda n: F.floor(F.log(n) / F.lit(float(np.log(_SIZES))))
        own = F.array(F.struct(size(F.col("n")).alias("size"), F.lit(False).alias("small")))
        wider = F.transform(F.sequence(size(F.col("n")), size(F.greatest(reach, F.col("n")))), lambda c: F.struct(c.alias("size"), F.lit(True).alias("small")))
        roles = F.explode(F.when(reach >= F.col("n"), F.concat(own, wider)).otherwise(own))
        held = first.withColumn("role", roles).select("key", "n", F.xxhash64("g", "role.size").alias("g"), "place", "role.small")
        held = checkpointed(held)
        both = held.groupBy("g").agg(F.bool_or("small").alias("some"), F.bool_and("small").alias("all"), F.min("key").alias("k0"), F.max("key").alias("k1"))
        return held.join(both.filter("some AND NOT all AND k0 < k1").select("g"), "g")

    def run(self) -> DataFrame:
        """(node, component). In each group every member is first compared with the group's smallest, which joins
        families of copies; then all pairs of different components in small groups are compared. The members of larger
        groups that still hold several components meet anew by their rarest shingles, which loses no pair: first in parts
        of those groups, which joins most of what is similar, then all that are still apart."""
        self.stars(self.held)
        rows = self.mixed(self.held)
        self.compare(self.pairs(rows.filter(F.col("m") <= self.crowd)))
        left = checkpointed(rows.filter(F.col("m") > self.crowd).select("key").distinct())
        if not left.isEmpty():
            held = checkpointed(self.rarest(left))
            self.stars(held)
            rows = self.mixed(held)
            for size in (self.crowd, 8 * self.crowd):
                large = rows.filter(F.col("m") > size)
                if large.isEmpty():
                    break
                self.compare(self.placed_pairs(self.dealt(large, size)))
                rows = self.mixed(held)
            self.compare(self.placed_pairs(rows))
        return self.found

    def dealt(self, rows: DataFrame, size: int) -> DataFrame:
        """The groups dealt by hash into parts of about `size`, another way in each group: a text that is similar to some of
        a large family meets one of them among a few, so that it needs not meet them all. Pairs that part here and stay in
        different components meet afterwards."""
        part = F.pmod(F.xxhash64("key", "g", F.lit(size)), F.ceil(F.col("m") / F.lit(size)))
        return rows.withColumn("g", F.xxhash64("g", part))


def _near(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, similarity: float, crowd: int) -> DataFrame:
    """(id, t, stays): t is a hash of the row's text, stays the struct (none, id, t) of the class's row that stays."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    sketched = plain.mapInArrow(_sketches(words), f"id {kind}, t long, fp long, n long, bands array<long>")
    ledger = checkpointed(sketched.withColumn("key", F.xxhash64("fp", "n", "bands")))
    keys = checkpointed(ledger.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("rep"), F.any_value("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    # Covering links on the fingerprints, between the smallest keys of each value.
    base = checkpointed(keys.groupBy("fp").agg(F.min("key").alias("low")))
    same = keys.select("key", "fp").join(base, "fp").filter("key != low").select(F.col("key").alias("u"), F.col("low").alias("v"))
    covered = links(base.select("fp"), radius, crowd)
    covered = covered.join(base.select(F.col("fp").alias("u"), F.col("low").alias("ku")), "u").join(base.select(F.col("fp").alias("v"), F.col("low").alias("kv")), "v").select(F.col("ku").alias("u"), F.col("kv").alias("v"))
    known = checkpointed(covered.unionByName(same))

    def texts(wanted: DataFrame) -> DataFrame:
        asked = keys.join(wanted, "key", "left_semi").select("key", F.col("rep.id").alias("aid"), F.col("rep.t").alias("at"))
        return plain.join(asked, F.col("id").eqNullSafe(F.col("aid")) & (F.col("t") == F.col("at"))).select("key", "text").dropDuplicates(["key"])

    found = _Search(keys, texts, known, words, similarity, crowd).run()
    named = checkpointed(keys.join(found, keys.key == found.node, "left").select("key", "rep", F.coalesce("component", "key").alias("component")))
    whole = checkpointed(named.groupBy("component").agg(F.min("rep").alias("stays")))  # so that a large component's join may be split
    classes = checkpointed(named.join(whole, "component").select("key", "stays"))
    return ledger.select("id", "t", "key").join(classes, "key").select("id", "t", "stays")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: id, component_id, over links of two kinds: fingerprints of word shingles within the
    covering radius, and a Jaccard similarity of `similarity` or more on the sets of word shingles, counted in full.

    Links of the second kind are sought among all pairs that agree on a MinHash band; see `BANDS` for the share of
    pairs that agree on none. In a band's group every member is compared with the smallest, which joins large families
    of copies; then members of different components pair by pair, in groups of at most `crowd`. The members of larger
    groups that still hold several components, such as texts around one common passage, meet anew by the rarest fifth
    of their shingles, without loss: a smaller and a larger text are compared where sizes and the places of a shared
    shingle leave room for the similarity.

    Null, empty and word-free texts are one class. Rows that repeat an id are judged by their text each. A null id
    takes part and gives the component its id only where it has no other. Other columns are ignored whatever their
    names. An empty table gives no rows.
    """
    rows = _near(docs, id_col, text_col, words, radius, similarity, crowd)
    return rows.select(F.col("id").alias(id_col), F.col("stays.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names: of each class of `near_components` the
    row with the smallest id, a row without an id only where there is no other; exact repeats of a row stay together."""
    rows = _near(docs, id_col, text_col, words, radius, similarity, CROWD)
    gone = rows.filter(~(F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("t") == F.col("stays.t")))).select(F.struct("id", "t").alias("k")).distinct()
    own = fresh("row", docs.columns)
    key = fresh("k", [*docs.columns, own])
    t = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    named = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), t.alias("t")))
    return named.join(gone.withColumnRenamed("k", key), F.expr(f"`{own}` <=> `{key}`"), "left_anti").drop(own)
