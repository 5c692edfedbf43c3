"""Cross-tokenizer alignment as relations: which tokens of two tokenizers cover the same bytes.

The core, `aligned`, takes two tables of tokens with their byte lengths. Windowed cumulative lengths give each token's
end; a full equi-join on text and end gives one row for each end that either tokenizer has. Where both have it is a cut;
running counts of cuts number the groups. Between two neighbouring ends lies exactly one link: of the token of A and the
token of B that cover it, the next ones to end. So there are as many links as ends, and no pairs are made and dropped.

Documents are not exploded into tokens. Both tokenizers cut a text before a lone space or line end (`boundary`), so a
text's groups are those of its words in turn; the core runs once over the different words of all documents, and documents
look their words up. The most frequent words, `common` of them at most, are broadcast; the rest, none of which is more
frequent than those, are joined. A document is split for the second and last time where it becomes the numbers of its
common words and the places of its rare ones, in a table bucketed by its key, so that what is said of its words comes
together without moving it again, and its groups are taken by number. Words and what is said of them lie in buckets too, and move no more than once. An id pair's
count is that of the documents whose words hold it, each counted where it lies; what follows from it are relations over words.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_path, small_batches, stored
from .tokens import _plain, piece_tokenizer

SPACE_MARK = "▁"
#: A character that is neither white space nor a control, format or unassigned one.
_SOLID = r"[^\x00-\x20\x7F-\xA0\p{Z}\p{C}]"
#: Before a space or line end that stands alone between two such characters. What comes is looked at first, as it seldom fits.
_BOUNDARY = rf"(?=[ \n]{_SOLID})(?<={_SOLID})"
#: Pairs that are broadcast, 32 bytes each or so; more are joined.
_PAIRS = 1 << 20
#: Matches nowhere: the whole text is one word.
_NOWHERE = r"(?!)"


#: Documents lie in two buckets for each shuffle partition, so that a bucket's words are sorted in memory; Spark takes at
#: most 100,000.
_BUCKETS = 50_000


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str):
    """A setting while in force; what runs meanwhile is written."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _together(spark: SparkSession):
    """Joins on a key and more use a partitioning by the key alone."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def _swept(spark: SparkSession):
    """Shuffle files go as soon as what they were made for is written, not when the driver next collects its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """df written as `stored` does, in n buckets by key: what is dealt by the key meets it without moving it. Each task
    writes a file for each bucket that it has rows of, so df is dealt by the key or small."""
    table = f"strandline_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", shared_path(df.sparkSession, name)).format("parquet").bucketBy(n, key).saveAsTable(table)
    return df.sparkSession.read.table(table)


def byte_lengths(path: str) -> np.ndarray:
    """The bytes of each id's entry in a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    out = np.zeros(max(vocab.values()) + 1, np.int32)
    for token, i in vocab.items():
        out[i] = len(token)  # a letter is a byte
    return out


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: the mark is a space, <0xHH> a byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
    return out


def boundary(path_a: str, path_b: str) -> str:
    """The pattern at whose matches both tokenizers cut every text. A byte-level file that splits by the usual pattern
    cuts there; a piece model does where no piece reaches from another character to a space or holds a line end."""
    with open(path_a, encoding="utf-8") as f:
        plain = _plain(json.load(f))
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    cut = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}|\n", p) for p in pieces)
    return _BOUNDARY if plain and cut else _NOWHERE


_models: dict[str, tuple] = {}


def _model(path: str) -> tuple:
    if path not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _models[path] = (model, piece_bytes(model), model.piece_to_id(SPACE_MARK))
    return _models[path]


def pieces_of(model: tuple, texts: list[str]) -> Iterator[list[int] | None]:
    """The ids of texts as they stand within a longer text; None where the pieces' bytes are not the text's. The model
    itself adds the space that a text may begin with; before anything else the mark it adds is a piece of its own."""
    processor, raw, mark = model
    found = processor.encode([t[1:] if t.startswith(" ") else t for t in texts], num_threads=1)
    for t, ids in zip(texts, found):
        if not t.startswith(" "):
            if not ids or ids[0] != mark:
                yield None
                continue
            ids = ids[1:]
        yield ids if b"".join([raw[i] for i in ids]) == t.encode() else None


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of runs of values, counts[i] of them at a time."""
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return before[ends] - before[ends - counts]


def _lists(values: np.ndarray | pa.Array, counts: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    """Runs of values as lists, null where missing."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values) if isinstance(values, np.ndarray) else values, mask=None if missing is None else pa.array(missing))


def _counts(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _tokens(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An id and a length in bytes as one number."""
    return (ids.astype(np.int64) << 32) + lengths


def tokenized(words: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(wid, a, b, unspelt) of words(wid, word): the tokens as arrays of ids and byte lengths, the two of a token in one
    number; where the bytes of either are not the word's, null arrays and the word itself, which is null elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, lengths = piece_tokenizer(path_a), _model(path_b), byte_lengths(path_a)
        widths = np.array([len(x) for x in second[1]], np.int32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                texts = part.column(1).to_pylist()
                coded, pieces = list(first.encode_batch(part.column(1))), list(pieces_of(second, texts))
                spelt = np.array([x is not None for x in pieces], bool)
                a, n = np.frombuffer(b"".join(coded), "<u4").astype(np.int32), np.array([len(x) // 4 for x in coded], np.int64)
                spelt &= _sums(lengths[a], n) == pc.binary_length(part.column(1)).to_numpy()
                a = a[np.repeat(spelt, n)]
                b = [x for x, ok in zip(pieces, spelt.tolist()) if ok]
                m = np.zeros(len(n), np.int64)
                m[spelt] = [len(x) for x in b]
                b = np.fromiter(chain.from_iterable(b), np.int32)
                lists = [_lists(_tokens(x, y), k, ~spelt) for x, y, k in ((a, lengths[a], n * spelt), (b, widths[b], m))]
                unspelt = pa.array([None if ok else t for t, ok in zip(texts, spelt.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, unspelt], names=["wid", "a", "b", "unspelt"])

    return words.select("wid", "word").mapInArrow(run, "wid long, a array<long>, b array<long>, unspelt string")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, end, grp, a, b, la, lb) from tokens a and b (doc, pos, id, n): a row for each end that a token has. a and b
    are the ids that end there, null for none; grp numbers the groups of a text from the last, 1, on; la and lb are the
    tokens of the link that ends there. n is at least 1, and both tables cover the same texts and bytes."""
    by_place = Window.partitionBy("doc").orderBy("pos")
    ends = [x.select("doc", F.col("id").alias(name), F.sum("n").over(by_place).alias("end")) for x, name in ((a, "a"), (b, "b"))]
    both = ends[0].join(ends[1], ["doc", "end"], "full")
    from_end = Window.partitionBy("doc").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    return both.select("doc", "end", F.sum(cut).over(from_end).alias("grp"), "a", "b", F.last("a", True).over(from_end).alias("la"), F.last("b", True).over(from_end).alias("lb"))


#: Rows of `aligned` that are put together at a time.
_ROWS = 1 << 16


def _texts(rows: pa.Table) -> pa.RecordBatch:
    """A row for each text of rows(place, doc, grp, a, b, la, lb), whole texts, each from its last end, place 1, on."""
    place, grp, a, b, la, lb = (pc.fill_null(rows[c], -1).to_numpy()[::-1] for c in ("place", "grp", "a", "b", "la", "lb"))
    last = place == 1
    ends = np.flatnonzero(last)
    n = np.diff(ends, prepend=-1)
    closed = last.copy()
    closed[:-1] |= grp[1:] != grp[:-1]
    groups = np.diff(np.cumsum(closed)[ends], prepend=0)
    of_group = np.diff(np.flatnonzero(closed), prepend=-1)
    sides = [pc.binary_join(_lists(pa.array(x[x >= 0]).cast(pa.string()), _sums(x >= 0, of_group)), ",") for x in (a, b)]
    text = pc.binary_join(_lists(pc.binary_join_element_wise(*sides, "|"), groups), ";")
    counts = [pa.array(x.astype(np.int64)) for x in (_sums(a >= 0, n), _sums(b >= 0, n), groups, n)]
    doc = pa.array(rows["doc"].to_numpy()[::-1][ends])
    return pa.RecordBatch.from_arrays([doc, *counts, text, _lists(_tokens(la, lb), n)], names=["doc", *_COUNTS, "groups", "links"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_texts` of batches whose texts may go on in the next one."""
    held, rows = [], 0
    for batch in batches:
        starts = np.flatnonzero(batch.column(0).to_numpy() == 1)
        rows += batch.num_rows
        if rows >= _ROWS and len(starts) and (held or starts[-1]):
            yield _texts(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]))
            batch = batch.slice(starts[-1])
            held, rows = [], batch.num_rows
        held.append(batch)
    if rows:
        yield _texts(pa.Table.from_batches(held))


def described(rows: DataFrame) -> DataFrame:
    """A row for each text of `aligned`: doc, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and links, an
    array of the linked pairs as often as they are linked, the two ids of a pair in one number. The window that numbers a
    text's ends from the last also brings them together in order; the window of `aligned` is the same."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("end").desc())).alias("place")
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select(place, "doc", "grp", "a", "b", "la", "lb").mapInArrow(_whole, f"doc {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups string, links array<long>")


def aligned_words(words: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """`described` for words(wid, word), wid being doc, in a table bucketed by it; a word whose tokens do not spell it has
    no row there, but in the second table, (word)."""
    spark = words.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), _BUCKETS)
    tokens = _bucketed(tokenized(words.select("wid", "word").repartition(n, "wid"), path_a, path_b), "wid", n, "tokens")
    unspelt = stored(tokens.filter("a IS NULL").select(F.col("unspelt").alias("word")), "unspelt")
    split = [tokens.filter("a IS NOT NULL").select(F.col("wid").alias("doc"), F.posexplode(x).alias("pos", "t")) for x in ("a", "b")]
    sides = [x.select("doc", "pos", F.shiftright("t", 32).cast("int").alias("id"), F.col("t").bitwiseAND(0x7FFFFFFF).cast("int").alias("n")) for x in split]
    with _together(spark):
        facts = _bucketed(described(aligned(*sides)), "doc", n, "words")
    discard(tokens)
    return facts, unspelt


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SUMS = (*_COUNTS, "n_best", "count_sum")


#: Numbers of common words from this one on, and what stands in their places among the shorter ones.
_LONG, _ELSEWHERE = 1 << 15, -2


def _codes(short: pa.ListArray, long: pa.ListArray) -> np.ndarray:
    """The numbers of the words of documents in turn, -1 for a rare one."""
    codes = short.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    codes[codes == _ELSEWHERE] = long.flatten().to_numpy(zero_copy_only=False)
    return codes


def _numbered(held):
    """Batches (k, id, words) to (k, id, codes, long, rare): a common word's number in `held` where it is below `_LONG`,
    else `_ELSEWHERE` and the number in long; -1 for a rare word, which comes with its place besides. A document without
    words has empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column(2).flatten(), _counts(b.column(2))
            codes = pc.fill_null(pc.index_in(words, value_set=held.value), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.cumsum(n)
            at, far = np.flatnonzero(codes < 0), np.flatnonzero(codes >= _LONG)
            row, of = (np.searchsorted(ends, x, side="right") for x in (at, far))
            places = (at - (ends - n)[row]).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(places), words.take(pa.array(at))], names=["pos", "word"])
            long = _lists(codes[far], np.bincount(of, minlength=len(n)))
            short = _lists(np.where(codes < _LONG, codes, _ELSEWHERE).astype(np.int16), n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), short, long, _lists(rare, np.bincount(row, minlength=len(n)))], names=["k", "id", "codes", "long", "rare"])

    return run


def _spread(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places offsets[i], ..., offsets[i] + counts[i] - 1 of all i in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - counts), counts)


def _once(keys: np.ndarray) -> np.ndarray:
    """The different ones of keys."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=keys[0] - 1) > 0] if len(keys) else keys


def _paired(held):
    """Batches (codes, long, list of the pairs of rare words) of documents to (pair, docs): how many of a task's documents
    hold a pair, in as many rows as batches for a pair that no common word has. `held` is (the pairs of the common words in
    order, how many of them each word has, their numbers among the pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, numbers = held.value
        starts = np.cumsum(counts) - counts
        seen = np.zeros(len(pairs), np.int64)
        for whole in batches:
            ends, lo = np.cumsum(_counts(whole.column(0))), 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _WORDS, side="right")))
                b, lo = whole.slice(lo, hi - lo), hi
                codes, n = _codes(b.column(0), b.column(1)), _counts(b.column(0))
                row = np.repeat(np.arange(len(n)), n)[codes >= 0]
                words = _once((row << 32) + codes[codes >= 0])
                row, words = words >> 32, words & 0xFFFFFFFF
                near = numbers[_spread(starts[words], counts[words])]
                links, m = b.column(2).flatten(), _counts(b.column(2))
                of_doc = np.repeat(np.repeat(np.arange(len(n)), m), _counts(links))
                links = links.flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(pairs, links)
                known = pairs[np.minimum(at, len(pairs) - 1)] == links if len(pairs) else np.zeros(len(links), bool)
                other, place = np.unique(links[~known], return_inverse=True)
                at[~known] = len(pairs) + place
                width = len(pairs) + len(other)
                found = _once(np.concatenate([np.repeat(row, counts[words]) * width + near, of_doc * width + at]))
                docs = np.bincount(found % width, minlength=width) if width else seen
                seen += docs[: len(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(other), pa.array(docs[len(pairs) :])], names=["pair", "docs"])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[seen > 0]), pa.array(seen[seen > 0])], names=["pair", "docs"])

    return run


#: Words whose groups are put together at a time.
_WORDS = 1 << 18


def _assembled(held):
    """Batches (id, codes, long, sums of the rare words, list of their places and groups) to (id, sums, groups) of documents;
    `held` has the sums and groups of the common words in order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = held.value
        weights = [pc.fill_null(facts[c], 0).to_numpy() for c in _SUMS]
        common = facts["groups"].combine_chunks()
        for whole in batches:
            ends, lo = np.cumsum(_counts(whole.column(1))), 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _WORDS, side="right")))
                b, lo = whole.slice(lo, hi - lo), hi
                codes, n = _codes(b.column(1), b.column(2)), _counts(b.column(1))
                known = codes >= 0
                sums = [_sums(np.where(known, w[codes] if len(w) else 0, 0), n) + b.column(3 + i).to_numpy() for i, w in enumerate(weights)]
                far, m = b.column(3 + len(_SUMS)).flatten(), _counts(b.column(3 + len(_SUMS)))
                take = codes.astype(np.int64)
                take[np.repeat(np.cumsum(n) - n, m) + far.field("pos").to_numpy()] = len(common) + np.arange(len(far))
                groups = pa.concat_arrays([common, far.field("groups")]).take(pa.array(take))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums), pc.binary_join(_lists(groups, n), ";")], names=["id", *_SUMS, "groups"])

    return run


def _frequent(words: DataFrame, most: int) -> pa.Table:
    """(wid, word) of the `most` most frequent words at most, of words(wid, word, uses), in order: the driver receives those
    and how many words have each count. Of the count where there are too many, those come that a hash selects."""
    above, found = 0, []
    for uses, n in sorted(map(tuple, words.groupBy("uses").count().collect()), reverse=True):
        if above + n > most:
            chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) <= int((most - above) / n * (1 << 20))
            found = [words.filter(F.col("uses") > uses), words.filter((F.col("uses") == uses) & chosen)]
            break
        above += n
    return pa.concat_tables([x.select("wid", "word", "uses").toArrow() for x in found or [words]]).sort_by([("uses", "descending")]).slice(0, most).select(["wid", "word"])


def _steps(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, common: int) -> tuple[DataFrame, DataFrame, DataFrame, pa.Table]:
    """The tables of which `align` puts its result together, all written: (k, id, codes, long) of documents, (k, the sums that
    need no pair's count, list) and (k, the others) of their rare words, and the sums and groups of the common words."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    m = min(int(spark.conf.get("spark.sql.shuffle.partitions")), _BUCKETS)
    n = min(2 * m, _BUCKETS)
    text = F.when(F.octet_length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col)))
    # Read once: the vocabulary and the documents must come of the same rows, also where docs gives others each time.
    docs = stored(docs.select(F.col(id_col).alias("id"), text.alias("full")), "full")
    split = F.split("full", boundary(path_a, path_b))
    words = docs.select(F.explode(split).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    words = _bucketed(words.withColumn("wid", F.monotonically_increasing_id()), "word", m, "vocabulary")
    facts, bad = aligned_words(words, path_a, path_b)
    facts = facts.withColumnRenamed("doc", "wid")
    numbers = _frequent(words.join(bad, "word", "left_anti"), common)  # unspelt words have no number
    numbers = numbers.append_column("code", pa.array(np.arange(len(numbers), dtype=np.int32)))
    by_number = spark.sparkContext.broadcast(pa.concat_arrays([*numbers["word"].chunks, pa.array([], numbers["word"].type)]))
    known = stored(spark.createDataFrame(numbers.select(["wid", "code"])), "numbers")
    # Bucketed by a key of the row's own, so that all that follows reads a document where it lies.
    keyed = docs.select(F.monotonically_increasing_id().alias("k"), "id", split.alias("words"))
    keyed = keyed.mapInArrow(_numbered(by_number), f"k long, id {kind}, codes array<short>, long array<int>, rare array<struct<pos: int, word: string>>")
    with small_batches(spark):
        texts = _bucketed(keyed.repartition(n, "k"), "k", n, "texts")
    discard(docs)
    if not bad.isEmpty():
        lost = stored(texts.select("k", F.inline("rare")).join(bad, "word", "left_semi").select("k").distinct(), "lost")
        texts = texts.join(lost.withColumn("gone", F.lit(True)), "k", "left").select("k", "id", *[F.when(F.col("gone").isNull(), F.col(c)).alias(c) for c in ("codes", "long", "rare")])
    rare = texts.select("k", F.inline("rare")).join(words.select("word", "wid"), "word").select("k", "pos", "wid")
    rare = _bucketed(rare.repartition(m, "wid"), "wid", m, "rare")
    discard(words)
    # What is said of a document's rare words, but for what the pairs' counts say.
    far = rare.join(facts, "wid").repartition(n, "k").groupBy("k")
    far = _bucketed(far.agg(*[F.sum(c).alias(c) for c in _COUNTS], F.collect_list(F.struct("pos", "groups")).alias("list"), F.collect_list("links").alias("links")), "k", n, "far")

    # How many documents hold a pair: the pairs of a document's common words and of its rare ones, each but once.
    linked = known.join(facts.select("wid", "links"), "wid").select("code", "links").toArrow().sort_by("code")["links"].combine_chunks()
    pairs, at = np.unique(linked.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    by_code = spark.sparkContext.broadcast((pairs, _counts(linked), at.astype(np.int32)))
    met = texts.select("k", "codes", "long").join(far.select("k", "links"), "k", "left").select("codes", "long", "links")
    held = stored(met.mapInArrow(_paired(by_code), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    most = held.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    ranked = stored(held.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")), "ranked")
    few = ranked.count() <= _PAIRS
    weighed = facts.select("wid", F.explode("links").alias("pair")).join(F.broadcast(ranked) if few else ranked, "pair")
    # A word that only lost documents hold has no weights, and no document asks for them.
    weights = _bucketed(weighed.groupBy("wid").agg(F.sum("docs").alias("count_sum"), F.sum("best").alias("n_best")), "wid", m, "weights")
    sums = rare.join(weights, "wid").groupBy("k").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = _bucketed(sums, "k", n, "sums")

    table = known.join(facts.drop("links"), "wid").join(weights, "wid", "left").select("code", *_SUMS, "groups").toArrow().sort_by("code")
    discard(facts, rare, weights)
    return texts, far, sums, table


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", common: int = 1 << 18) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, the text of all groups.

    A encodes a space and the text, B the text, to which it adds a space itself. Null and empty texts, and those whose
    tokens do not spell a space and the text, have no tokens: zeros and no groups, and they count for no pair. An id
    pair's count is the number of documents that hold it linked, repeated rows being documents each. Other columns
    are ignored; an empty table gives no rows. At most `common` words are broadcast.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    with _swept(spark):
        texts, far, sums, table = _steps(docs, path_a, path_b, id_col, text_col, common)
    total = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _SUMS]
    both = texts.select("k", "id", "codes", "long").join(far.drop("links"), "k", "left").join(sums, "k", "left").select("id", "codes", "long", *total, "list")
    out = both.mapInArrow(_assembled(spark.sparkContext.broadcast(table)), f"id {kind}, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups string")
    return out.withColumnRenamed("id", id_col)


def alignment_digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`align` with its groups as a digest, '' for none."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return align(docs, path_a, path_b).select("doc_id", *_COUNTS, "n_best", "count_sum", digest)
