"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import mix, set_key, shingle_set, word_hashes
from .common import BROADCAST_BYTES, broadcast_if_small, materialise, pieces, table
from .components import connected_components

#: Incidence entries (document, shingle) and documents of one block of a family of candidates, on average: two blocks bound the memory of a product.
BLOCK_ENTRIES, BLOCK_ROWS = 200_000, 800
#: Signatures that are shuffled at once, while that takes no more than so many passes over them.
SLICE_SIGNATURES, SLICES = 16_000_000, 16
#: Incidence entries of families that are shuffled at once, likewise.
SLICE_ENTRIES = 100_000_000
#: Counters of shingles in large families, as a power of two at most. Any order of shingles that all documents share gives right prefixes; this one only has to tell common ones.
COUNTER_BITS = 21
#: Columns of the incidence matrix that one dense product takes at a time.
COLUMNS = 4096
_U = np.uint64


#: Sets of one size class differ by this factor at most, so sets that link lie in one class or in two that touch.
CLASS_RATIO = 2.2


def _size_classes(top: int = 1 << 40) -> list[int]:
    """Largest set size of each class."""
    highs = [1]
    while highs[-1] < top:
        highs.append(max(highs[-1] + 1, math.floor((highs[-1] + 1) * CLASS_RATIO)))
    return highs


_HIGH = _size_classes()


@cache
def _fill(num: int, den: int) -> float:
    """Shingles of a block, on average, in the largest sets of a class: as many as leave enough blocks with two shingles or more for the signatures that are needed."""
    if den * 10 > num * 10 * CLASS_RATIO:
        raise ValueError(f"similarities under 1 / {CLASS_RATIO} aren't supported")
    need = 1.06 * (den - num) / num
    return max((x / 10 for x in range(18, 61) if (1 - math.exp(-x / 10) * (1 + x / 10)) / (x / 10) >= need), default=1.8)


def block_signatures(values: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of which two sets share one at least if their Jaccard similarity reaches num / den, unless the sets are equal.

    The n-gram columns are cut into blocks, whose number depends on the size class. A set of n shingles and one of m that link miss at most
    (n + m)(den - num) / (den + num) shingles between them, and m is n den / num at most: that bounds the blocks d in which they differ. So of the contents
    of the blocks that aren't empty all but d are shared, and by the bound of prefix filters the first d + 1 in any order of contents are enough; here
    those with the most shingles come first, as they are the least common. A set with no more than d such blocks also gives its prefix of shingles.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    out = []
    first = bisect_left(_HIGH, n)
    position = mix(values) >> _U(32)
    for c in (first, first + 1):
        if c > first and den * n < num * (_HIGH[c - 1] + 1):  # no set of the next class is small enough to link
            continue
        d = (n + min(n * den // num, _HIGH[c])) * (den - num) // (den + num)
        if d == 0:
            continue
        blocks = math.ceil(_HIGH[c] / _fill(num, den)) + 1
        block = (position * _U(blocks)) >> _U(32)
        order = np.argsort(block, kind="stable")
        held, start, count = np.unique(block[order], return_index=True, return_counts=True)
        tag = _U((c * 0x9E3779B1 + num * 1009 + den) & 0xFFFFFFFF) << _U(24)
        content = mix(np.add.reduceat(mix(values[order] + _U(7)), start) ^ mix(held + tag))
        out.append(content[np.lexsort((content, -count))[: d + 1]])
        if len(content) <= d:
            out.append(mix(values[: n - (-(-n * num // den)) + 1] ^ _U(0x5851F42D4C957F2D)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _incidence(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in pieces(batches, "text"):
            n, k1, k2, sigs = [], [], [], []
            for doc_id, words in zip(b.column(0).to_pylist(), word_hashes(b.column(1).to_pylist()), strict=True):
                values = shingle_set(words, k)
                n.append(len(values))
                key = set_key(values) if len(values) else (None, None)
                k1.append(key[0])
                k2.append(key[1])
                if len(values) and doc_id is not None and key not in done:  # copies that this task has seen add nothing, and a null doc_id links with nothing
                    done.add(key)
                    sigs.append(block_signatures(values, num, den))
                else:
                    sigs.append(None)
            if len(done) > 500_000:
                done.clear()
            lists = pa.array(sigs, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], names=["doc_id", "n_shingles", "k1", "k2", "sigs"])

    return run


def _counts(k: int, bits: int):
    """(slot, n): how many shingles of the task's sets fall in each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for b in pieces(batches, "text"):
            for words in word_hashes(b.column("text").to_pylist()):
                np.add.at(total, shingle_set(words, k) & _U((1 << bits) - 1), 1)
        slot = np.flatnonzero(total)
        for at in range(0, len(slot), 100_000):
            some = slot[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    return run


def rare_prefix(values: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set by the counters, so many that two sets whose Jaccard similarity reaches num / den share one of them."""
    n = len(values)
    order = np.lexsort((values, counts[values & _U(len(counts) - 1)]))
    return values[order[: n - (-(-n * num // den)) + 1]].view(np.int64) if n else values.view(np.int64)


def _prefixes(k: int, num: int, den: int, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sigs = [rare_prefix(shingle_set(w, k), counts, num, den) for w in word_hashes(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    return run


def _rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sets = [shingle_set(w, k).view(np.int64) for w in word_hashes(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "family", "blocks")), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "family", "blocks", "row"])

    return run


def product_links(ids: list[int], rows: list[np.ndarray], num: int, den: int) -> dict[int, int]:
    """Each document that links within the block and isn't the first of its component, with that first; overlaps come from products of column strips."""
    order = np.argsort(ids, kind="stable")
    ids, rows = [ids[i] for i in order], [rows[i] for i in order]
    size = np.array([len(r) for r in rows])
    _, inverse, held = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    doc, shared = np.repeat(np.arange(len(rows)), size), held[inverse] > 1
    column = np.cumsum(held > 1)[inverse[shared]] - 1
    doc = doc[shared]
    overlap = np.zeros((len(rows), len(rows)), dtype=np.float32)
    by = np.argsort(column, kind="stable")
    doc, column = doc[by], column[by]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, (at, at + COLUMNS))
        strip = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        strip[doc[a:z], column[a:z] - at] = 1
        overlap += strip @ strip.T
    linked = np.empty(overlap.shape, dtype=bool)
    for i in range(0, len(rows), 256):  # a few rows at a time keep the integers small
        shares = overlap[i : i + 256].astype(np.int64)
        linked[i : i + 256] = den * shares >= num * (size[i : i + 256, None] + size[None, :] - shares)
    left, stars = np.ones(len(rows), dtype=bool), {}
    for i in range(len(rows)):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            stars.update((ids[j], ids[i]) for j in front)
    return stars


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in a partition that is sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        values = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and values[end] == values[at]:
                end += 1
            if values[at] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = values[at]
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield now, pa.Table.from_batches(held)


def _products(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["family", "one", "two"]):
            ids = t.column("doc_id").to_pylist()
            if len(ids) > 1:
                stars = product_links(ids, [np.array(r, dtype=np.int64) for r in t.column("row").to_numpy(zero_copy_only=False)], num, den)
                yield pa.RecordBatch.from_arrays([pa.array(stars.keys(), pa.int64()), pa.array(stars.values(), pa.int64())], names=["a", "b"])

    return run


def _large_families(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Block pairs (doc_id, family, row, one, two) of families of several blocks, and links (a, b) of their members to their first.

    Every member is compared with the family's first document. Those that link with it are connected, so no product of two of their blocks is needed: the rest are
    multiplied with each other and with them. A large group of near copies of its first document then takes one pass, whatever its size.
    """
    pivots = rows.where("doc_id = family").groupBy("family").agg(F.min("row").alias("pivot"))
    entries = pivots.agg(F.sum(F.size("pivot") + 8)).first()[0] or 0
    seen = rows.join(broadcast_if_small(pivots, entries, 8), "family")
    shared = F.size(F.array_intersect("row", "pivot"))
    linked = (F.col("doc_id") != F.col("family")) & (den * shared.cast("long") >= num * (F.size("row") + F.size("pivot") - shared).cast("long"))
    seen = materialise(seen.select("doc_id", "family", "row", (linked | (F.col("doc_id") == F.col("family"))).alias("core")), "pivots")
    near = seen.where("core and doc_id > family").select(F.col("family").alias("a"), F.col("doc_id").alias("b"))
    sides = seen.groupBy("family").agg(*[F.greatest(F.ceil(F.sum(F.when(side, F.size("row")).otherwise(0)) / BLOCK_ENTRIES), F.ceil(F.count_if(side) / BLOCK_ROWS)).cast("int").alias(name) for name, side in (("rests", ~F.col("core")), ("cores", F.col("core")))])
    sides = sides.where("rests > 0")
    placed = seen.join(broadcast_if_small(sides, sides.count(), 40), "family")
    mine = F.when(F.col("core"), F.col("rests") + F.pmod(F.xxhash64("doc_id"), F.col("cores"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.greatest("rests", F.lit(1)))).cast("int")
    last = F.when(F.col("core"), F.col("rests")).otherwise(F.col("rests") + F.col("cores")) - 1
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("doc_id", "family", "row", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two")), near


def _once(seen: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of seen with signatures, one document for each set: tasks that met copies of a set made signatures for each. The smaller list of documents is sent to the tasks."""
    some = first.agg(F.count("*").alias("sets"), F.sum("n").alias("rows")).first()
    spare = (some.rows or 0) - some.sets
    rows, key = seen.where("sigs is not null"), ["doc_id", "k1", "k2"]
    if spare > some.sets:
        return rows.join(broadcast_if_small(first.select(F.col("rep").alias("doc_id"), "k1", "k2"), some.sets, 56), key, "left_semi")
    if spare:
        copies = materialise(rows.join(first, ["k1", "k2"]).where("doc_id <> rep").select(*key), "copies")
        return rows.join(broadcast_if_small(copies, spare, 56), key, "left_anti")
    return rows


def _chains(signed: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the documents (doc_id, sigs) that share a signature.

    Each task adds up a signature's rows before the shuffle, so one that many near copies share arrives as a row a task. A slice of the signatures is shuffled at a time, whether for
    adding them up or for finding all documents of those that more than two share.
    """
    shared = signed.select("doc_id", F.explode("sigs").alias("sig"))
    slices = min(SLICES, max(1, -(-(signed.agg(F.sum(F.size("sigs"))).first()[0] or 0) // SLICE_SIGNATURES)))
    edges = None
    for part in range(slices):
        mine = shared.where(F.pmod("sig", F.lit(slices)) == part) if slices > 1 else shared
        found = mine.groupBy("sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("high > low")
        found = materialise(found, "signatures")
        many = found.where("n > 2").select("sig", "low")
        rest = mine.join(broadcast_if_small(many, many.count(), 48), "sig").where("doc_id > low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
        chained = materialise(found.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(rest).distinct(), "chains")
        edges = chained if edges is None else edges.unionByName(chained)
    return edges


def _families(chains: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, family, n, blocks) of the documents that chains connect, where sizes (doc_id, n) has their shingles."""
    family = connected_components(chains).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sized = family.join(sizes, "doc_id")
    blocks = sized.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_ENTRIES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
    return materialise(sized.join(blocks, "family").select("doc_id", "family", "n", "blocks"), "families")


def _slices(part: DataFrame) -> list[tuple[DataFrame, int]]:
    """The families of part (doc_id, family, n) in slices of which each can be sent to the tasks and has so many entries at most, while they are no more than SLICES; with their numbers of documents."""
    size = part.agg(F.count("*").alias("docs"), F.sum("n").alias("entries")).first()
    slices = min(SLICES, max(1, -(-size.docs * 50 // BROADCAST_BYTES), -(-(size.entries or 0) // SLICE_ENTRIES)))
    if slices == 1:
        return [(part, size.docs)] if size.docs else []
    cuts = [part.where(F.pmod(F.xxhash64("family"), F.lit(slices)) == i) for i in range(slices)]
    return [(cut, cut.count()) for cut in cuts]


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Link documents (doc_id, text) whose k-word shingle sets have a Jaccard similarity of num / den or more; a row (doc_id, n_shingles, component_id) for each.

    component_id is the smallest doc_id that links reach; a doc_id may have any type that has an order (others than integers go by their 64-bit hashes inside). Words are split at
    ASCII white space with A-Z in lower case; a text of fewer than k words is one shingle; a null or empty text has none, links with nothing and is its own component. Long texts
    are read whole. Rows that repeat a doc_id count as one document with several texts. A row with a null doc_id links with nothing and has a null component_id.
    Other columns of docs play no part.

    1. One pass makes for each text its set's size and 128-bit key, and block signatures (see block_signatures) of sets that the task hasn't seen.
    2. Equal sets link by their key, whatever their number: the rows of a group of copies aren't compared.
    3. Signatures chain the documents that share one; the components of the chains are families of candidates, a superset of the links.
    4. Passages that many documents quote chain families together that have nothing else in common, the larger the more documents there are. Families of several blocks are therefore
       made anew: documents are chained by the prefixes of their sets, rarest shingles first (see rare_prefix), which hold no common passage unless most of the set is one.
    5. Each family's incidence rows are cut into blocks of BLOCK_ENTRIES or BLOCK_ROWS, each pair of blocks is multiplied in one task, which accumulates
       overlaps over strips of columns and returns only a spanning forest of the pairs that pass the exact test; see _large_families for those of several blocks.
       A slice of the families is shuffled at a time, and texts are never.
    Shingles are 64-bit hashes; a collision can change an overlap by one.
    """
    kind = docs.schema["doc_id"].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("node")
        names = docs.select(node, "doc_id").where("node is not null").distinct()
        out = jaccard_components(docs.select(node.alias("doc_id"), "text"), k, num, den).withColumnRenamed("doc_id", "node")
        least = out.select("node", "component_id").distinct().join(names, "node").groupBy("component_id").agg(F.min("doc_id").alias("least"))
        return out.join(names, "node", "left").join(least, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    clean = docs.select(F.col("doc_id").cast("long"), "text")
    seen = materialise(clean.mapInArrow(_incidence(k, num, den), "doc_id long, n_shingles long, k1 long, k2 long, sigs array<long>"), "incidence")
    sets = seen.select("doc_id", "n_shingles", "k1", "k2").where("k1 is not null and doc_id is not null")
    first = materialise(seen.where("sigs is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    copies = sets.join(first, ["k1", "k2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sizes = sets.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    member = _families(_chains(_once(seen, first)), sizes)

    def texts(part: DataFrame, n: int) -> DataFrame:
        return clean.join(broadcast_if_small(part.select("doc_id", "family", "blocks"), n, 40), "doc_id")

    def incidence(part: DataFrame, n: int) -> DataFrame:
        return texts(part, n).mapInArrow(_rows(k), "doc_id long, family long, blocks int, row array<long>")

    cut = _slices(member.where("blocks > 1"))
    if cut:
        entries = member.where("blocks > 1").agg(F.sum("n")).first()[0]
        bits = min(COUNTER_BITS, max(10, entries.bit_length()))
        counted = reduce(DataFrame.unionByName, [texts(*c).mapInArrow(_counts(k, bits), "slot long, n long") for c in cut]).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(1 << bits, dtype=np.uint32)
        counts[counted["slot"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 0xFFFFFFFF)
        prefixes = reduce(DataFrame.unionByName, [texts(*c).mapInArrow(_prefixes(k, num, den, counts), "doc_id long, sigs array<long>") for c in cut])
        finer = _families(_chains(materialise(prefixes, "prefixes")), sizes)
        member = member.where("blocks = 1").unionByName(finer)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two")
        return materialise(pairs.mapInArrow(_products(num, den), "a long, b long"), "links")

    links = copies
    for part, n in _slices(member.where("blocks = 1")):
        links = links.unionByName(linked(incidence(part, n).select("doc_id", "family", "row", F.lit(0).alias("one"), F.lit(0).alias("two"))))
    for part, n in _slices(member.where("blocks > 1")):
        pairs, near = _large_families(materialise(incidence(part, n), "large"), num, den)
        links = links.unionByName(linked(pairs)).unionByName(near)
    joined = connected_components(links)
    out = seen.select("doc_id", "n_shingles").join(joined, seen["doc_id"] == joined["node"], "left")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", F.coalesce("component", "doc_id").cast(kind).alias("component_id"))


def keep_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's, one row for each: of rows that repeat a doc_id, the first by text. Rows with a null doc_id stay.

    The components are written once. While the ids that go, or those that stay, are few, they are sent to the tasks, and the texts stay where they are.
    """
    components = materialise(components, "components").where("doc_id is not null")
    stays = F.col("doc_id") == F.col("component_id")
    gone, left = components.where(~stays).select("doc_id").distinct(), components.where(stays).groupBy("doc_id").agg(F.count("*").alias("_rows"))
    n = components.agg(F.count_if(~stays).alias("gone"), F.count_if(stays).alias("left")).first()
    if n.gone <= n.left:
        kept = docs.where("doc_id is not null").join(broadcast_if_small(gone, n.gone, 40), "doc_id", "left_anti")
    else:
        kept = docs.join(broadcast_if_small(left.select("doc_id"), n.left, 40), "doc_id", "left_semi")
    again = materialise(left.where("_rows > 1").select("doc_id"), "repeated")
    repeated = again.count()
    if repeated:
        order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text"), F.xxhash64(*[F.col(c) for c in docs.columns]))
        small = broadcast_if_small(again, repeated, 40)
        spare = kept.join(small, "doc_id", "left_semi").withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")
        kept = kept.join(small, "doc_id", "left_anti").unionByName(spare)
    return kept.unionByName(docs.where("doc_id is null"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def components_sql(k: int, num: int, den: int, docs: str) -> str:
    """Common table expressions for DuckDB from a relation docs(doc_id, text) to components(doc_id, n_shingles, component_id)."""
    return rf"""
worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from {docs}),
shingled as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < {k} then [array_to_string(w, ' ')]
   else list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) end) as s from worded)),
counted as (select doc_id, count(*) as n from shingled group by doc_id),
classes as (select doc_id, min(doc_id) over (partition by h) as rep from (select doc_id, md5(string_agg(s, chr(0) order by s)) as h from shingled group by doc_id)),
rare as (select s, count(*) as df from shingled join classes c using (doc_id) where c.rep = doc_id group by s),
prefixes as (select doc_id, s, n from (select x.doc_id, x.s, n, row_number() over (partition by x.doc_id order by df, x.s) as place from shingled x join classes c on x.doc_id = c.doc_id and c.rep = c.doc_id join rare using (s) join counted on x.doc_id = counted.doc_id)
   where place <= n - ceil({num} * n / {den}.0) + 1),
candidates as (select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from prefixes a join prefixes b on a.s = b.s and a.doc_id < b.doc_id and {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)),
counts as (select x, y, any_value(nx) as nx, any_value(ny) as ny, count(*) as o from candidates join shingled a on a.doc_id = x join shingled b on b.doc_id = y and a.s = b.s group by x, y),
links as (select x, y from counts where {den} * o >= {num} * (nx + ny - o) union all select rep, doc_id from classes where rep < doc_id),
both_ways as (select x, y from links union select y, x from links),
reached as (select distinct x as root, x as node from both_ways union select root, y from reached join both_ways on node = x),
components as (select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(low, doc_id) as component_id
   from worded left join counted using (doc_id) left join (select node as doc_id, min(root) as low from reached group by node) using (doc_id))"""


SQL = {"op5_ngram_join": f"with recursive {components_sql(4, 85, 100, 'documents')} select doc_id, n_shingles, component_id from components"}
