"""Exact self-join of word-shingle sets under the Jaccard metric, by regions.

Jaccard distance is a metric, also between the parts of two sets that fall into any part
of the universe of shingles; and of the parts of a pair that is close overall at least one
is as close (the overall similarity is a weighted mean of the parts'). Regions are built
recursively on that:

* The universe, shingle hashes, is halved again and again for a document until it has at
  most LEAF shingles in a part. Two different sets of that size are further apart than the
  radius, so there the window that the triangle inequality gives around a point holds the
  point alone: close documents have an equal leaf. A document is replicated to the regions
  of all its leaves; every close pair meets in one of them at least.
* In each region the document with the smallest id is the pivot, and the exact distances
  of all members to the pivots of their regions are computed: the Voronoi step. Members
  within the radius are linked with the pivot.
* A region whose members are all connected by then needs no more. In the others, members
  of different components are compared if the windows of all pivots leave them a chance:
  that of the region's pivot p, |d(x,p) - d(y,p)| <= radius, and those of PARTS fixed
  pivots, the parts of the universe: |x & P| and |y & P| differ by no more than the
  symmetric difference of x and y has in P, so the sum over all parts bounds it. Sizes are
  the window of the empty set. SIGNS finer parts tell only whether |x & P| is odd: each in which
  x and y differ holds one of their symmetric difference at least, and few hold two, so near
  texts that are no link seldom pass. Nothing that a window drops can be a link.
* A pair is compared, with its pivot or otherwise, only if the regions in which it meets that
  way hold as much of it as a close pair has there (`must_share`): a few equal leaves, as of
  a common passage, don't make two long documents close.

Pivots that are documents do not work at the top: texts of their own have distance 1 to
nearly every pivot, so each window would hold nearly all of them. Hence the leaves.

Classes of equal sets are joined as one document. Components follow from the links.

Defined results: a null, empty or blank text has the empty set and links with nothing,
not even with its like; a text with fewer words than a shingle has its words as the one
shingle; rows with the same id are one document, each with its own size, and each of its
texts links on its own; rows without an id take part through an equal set that has one,
otherwise their component is null; repeated rows come out each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh_name, text_batches
from riskloom.session import checkpoint

#: Similarity in hundredths, words of a shingle, parts of the universe used as pivots, and the
#: finer parts of which only odd or even is kept.
LEAST, WORDS, PARTS, SIGNS = 90, 3, 64, 2048

_U = np.uint64
_PRIME, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WIDE = (1 << 64) - 1


def leaf_size(least: int = LEAST) -> int:
    """Largest size at which two different sets are always less similar than `least`."""
    return max(1, -(-least // (100 - least)) - 1) if least < 100 else 1 << 30


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODES = mix(np.arange(1, 257, dtype=_U) * _U(_PRIME))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=_U)
    if n:
        out[0] = 1
        np.multiply.accumulate(np.concatenate([out[:1], np.full(n - 1, base, dtype=_U)]), out=out)
    return out


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The set of a text as sorted distinct 64-bit hashes."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(_CODES[_FOLD[data]] * powers(len(data), _PRIME), dtype=_U)])
        word = mix((sums[end] - sums[start]) * powers(len(data), _INVERSE)[start] + (end - start).astype(_U))
        if len(word) < words:
            value = np.full(1, len(word), dtype=_U)
            for w in word:
                value = mix(value * _U(_PRIME) + w)
            return value
        value = np.full(len(word) - words + 1, words, dtype=_U)
        for k in range(words):
            value = mix(value * _U(_PRIME) + word[k : len(word) - words + 1 + k])
    return np.unique(value)


def leaves(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the leaves of a sorted set, each of its place in the universe and its content,
    with the leaf's number of shingles in the low seven bits."""
    out, mixed, depth = [], mix(values + _U(_PRIME)), 0
    with np.errstate(over="ignore"):
        while len(values):
            part = values >> _U(64 - depth) if depth else np.zeros(len(values), dtype=_U)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            count = np.diff(np.append(first, len(values)))
            done = (count <= size) | (depth >= 63)
            if done.any():
                content = np.add.reduceat(mixed, first)
                place = mix(content[done] + mix(part[first][done] * _U(_PRIME) + _U(depth + 1)))
                out.append((place & ~_U(_MASS)) | np.minimum(count[done], _MASS).astype(_U))
                stay = np.repeat(~done, count)
                values, mixed = values[stay], mixed[stay]
            depth += 1
    return np.concatenate(out) if out else np.empty(0, dtype=_U)


def digest_of(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


#: Largest size that a region's hash can carry in its low bits.
_MASS = 127

ROWS = "id long, n long, digest binary, parts array<tinyint>, signs array<long>, leaves array<long>"


def document_rows(docs: DataFrame, words: int, size: int) -> DataFrame:
    """id, set size and digest of each row; of the sets that are not empty also their counts in
    the parts of the universe (up to 127), their signs and the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or "", words) for t in b.column(1).to_pylist()]
            own = [s if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest_of(s) for s in sets], pa.binary()),
                    pa.array([None if s is None else part_counts(s) for s in own], pa.list_(pa.int8())),
                    pa.array([None if s is None else odd_parts(s) for s in own], pa.list_(pa.int64())),
                    pa.array([None if s is None else leaves(s, size).astype(np.int64) for s in own], pa.list_(pa.int64())),
                ],
                names=["id", "n", "digest", "parts", "signs", "leaves"],
            )

    return docs.select("id", "text").mapInArrow(run, ROWS)


def part_counts(values: np.ndarray) -> np.ndarray:
    place = (values & _U(PARTS - 1)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=PARTS), 127).astype(np.int8)


def odd_parts(values: np.ndarray) -> np.ndarray:
    """A bit for each of the SIGNS parts of the universe: whether it holds an odd number."""
    place = (values >> _U(8) & _U(SIGNS - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SIGNS) & 1).astype(np.uint8)).view(np.int64)


def region_members(members: DataFrame) -> DataFrame:
    """region, key and pivot (the smallest key) of the regions with two members or more, from
    (region, key): one shuffle, then one pass along the sorted partitions, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, pivot, alone = None, 0, False
        for batch in batches:
            r, i = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(r):
                continue
            if alone and r[0] == region:  # the row held back has company
                r, i = np.concatenate([[region], r]), np.concatenate([[pivot], i])
                goes_on = False
            else:
                goes_on = r[0] == region
            first = np.flatnonzero(np.concatenate([[not goes_on], r[1:] != r[:-1]]))
            length = np.diff(np.append(first, len(r)))
            head = first[0] if len(first) else len(r)
            pivots = np.concatenate([np.full(head, pivot, dtype=np.int64), np.repeat(i[first], length)])
            kept = np.concatenate([np.ones(head, dtype=bool), np.repeat(length > 1, length)])
            region, pivot = r[-1], int(pivots[-1])
            alone = len(first) > 0 and bool(length[-1] == 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept], pa.int64()) for x in (r, i, pivots)], names=["region", "key", "pivot"])

    return members.repartition("region").sortWithinPartitions("region", "key").mapInArrow(run, "region long, key long, pivot long")


#: Bits of the filter that spares most texts a second look. A fixed size, whatever the table.
FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame) -> dict[int, bytes]:
    """Bitmaps by number, FILTER_BITS bits in all, of hashed ids: every id's bit is set, and
    few others."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1  # bitmap numbers and positions count from 1
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return {r["number"]: bytes(r["bits"]) for r in maps.collect()}


def split_by(rows: DataFrame, value: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose value is surely not among `ids`, and the others: all that are among them
    and few that are not. Only the others need to be shuffled for an exact join."""
    number, bits = fresh_name(rows, "number"), fresh_name(rows, "bits")

    def place(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(FILTER_BITS)) + 1

    of_id = place(F.col("id"))
    maps = ids.groupBy(F.bitmap_bucket_number(of_id).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of_id)).alias(bits))
    at = F.bitmap_bit_position(place(value)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    numbered = rows.withColumn(number, F.bitmap_bucket_number(place(value))).join(F.broadcast(maps), number, "left")
    return numbered.where(~held).select(rows.columns), numbered.where(held).select(rows.columns)


def sets_of(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """key, size and set of these classes (key, id, digest). The filter of ids drops most
    other texts where they are read; the exact join by digest has only what passes."""
    bits = id_filter(classes.select("id"))
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    numbered = docs.select("id", "text", F.bitmap_bucket_number(place).alias("number"), F.bitmap_bit_position(place).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            hit = [n in bits and bool(bits[n][p >> 3] >> (p & 7) & 1) for n, p in places]
            sets = [s for t in b.column(1).filter(pa.array(hit, pa.bool_())).to_pylist() if len(s := shingles(t or "", words))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "values"]
            )

    found = numbered.mapInArrow(run, "digest binary, values array<long>")
    return found.join(classes.select("digest", "key"), "digest").groupBy("key").agg(F.first("values").alias("values")).select("key", F.size("values").cast("long").alias("n"), "values")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b with the sizes of both sets and of their intersection."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("values").alias("values_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("values").alias("values_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("values_a", "values_b")).cast("long").alias("common"))


def is_link(least: int):
    return 100 * F.col("common") >= least * (F.col("n_a") + F.col("n_b") - F.col("common"))


def distance():
    return 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id that links lead to. Each round every node takes the
    smallest label around it and then its label's label, until nothing changes."""
    if links.isEmpty():
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    edges = checkpoint(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "m").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("further"))
        moved = checkpoint(step.join(jump, "new").select("id", F.col("component").alias("old"), F.least("new", "further").alias("component")))
        changed = moved.where("component != old").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels


#: Members from which a region counts as hot, and its members are looked at before they meet.
HOT = 200


def hot_share(least: int) -> float:
    """Least share of the union of two close sets that lies in their equal leaves. Elsewhere the
    parts' similarity is size / (size + 1) at most, and the whole is a weighted mean."""
    other = (size := leaf_size(least)) / (size + 1)
    return (least / 100 - other) / (1 - other)


def in_region():
    """The number of shingles that a member of a region has in its leaf."""
    return F.col("region").bitwiseAND(_MASS)


def without_chance_meetings(met: DataFrame, sizes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The members of regions less those whom only chance brought into a hot one, such as a
    passage that very many documents share. Two close sets that meet in hot regions alone have
    `hot_share` of their union in them, so a set with less of it there meets all that it is close
    to elsewhere. With it, the number of shingles (missed) that each set left out has in them."""
    hot = met.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > HOT).select("region")
    told = checkpoint(met.join(hot.withColumn("hot", F.lit(True)), "region", "left"))
    inside = told.where("hot").select("region", "key")
    mass = inside.groupBy("key").agg(F.sum(in_region()).alias("mass"))
    is_heavy = F.col("mass") >= hot_share(least) * F.col("n") - 1e-9
    weighed = checkpoint(mass.join(sizes.select("key", "n"), "key").select("key", "mass", is_heavy.alias("heavy")))
    stay = inside.join(weighed.where("heavy"), "key", "left_semi")
    heads = stay.groupBy("region").agg(F.min("key").alias("pivot"))
    left = told.where("hot IS NULL").select("region", "key", "pivot").union(stay.join(heads, "region").select("region", "key", "pivot"))
    return left, weighed.where("NOT heavy").select("key", F.col("mass").alias("missed"))


def must_share(least: int):
    """Shingles that a close pair has at least in the regions where it meets the one way or the
    other: one is the other's pivot, or neither is. Equal leaves hold `hot_share` of the union;
    what both miss in hot regions aside, one of the two ways has half of it."""
    return hot_share(least) / 2 * F.greatest("n_a", "n_b") - F.col("missed_a") - F.col("missed_b") - 1e-9


def near_sizes(least: int):
    """Whether the windows of the fixed pivots (set sizes, counts in the parts and odd ones of the
    finer parts) let a pair be close; columns n, parts and signs with the endings _a and _b."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    differ = F.aggregate(F.zip_with("parts_a", "parts_b", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, v: s + v)
    odd = F.aggregate(F.zip_with("signs_a", "signs_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    most = (100 - least) * (n_a + n_b)
    return (100 * F.least(n_a, n_b) >= least * F.greatest(n_a, n_b)) & ((100 + least) * differ <= most) & ((100 + least) * odd <= most)


def find_links(entries: DataFrame, classes: DataFrame, docs: DataFrame, words: int, least: int, every: bool = False) -> DataFrame:
    """a, b: links between keys enough to connect all that links connect, or every link.
    `entries` has the region and key of the leaves, `classes` key, id, digest, n, parts and
    signs of the different sets."""
    met, left_out = without_chance_meetings(checkpoint(region_members(entries)), classes, least)
    met = checkpoint(met)
    narrow = classes.join(met.select("key").distinct(), "key", "left_semi").join(left_out, "key", "left")
    narrow = narrow.select("key", "n", "parts", "signs", F.coalesce("missed", F.lit(0)).alias("missed"))
    a, b = (narrow.select(*[F.col(c).alias(f"{c}_{side}") for c in narrow.columns]) for side in "ab")
    with_pivot = met.where("key != pivot").groupBy(F.col("key").alias("key_a"), F.col("pivot").alias("key_b")).agg(F.sum(in_region()).alias("shared"))
    close = near_sizes(least) & (F.col("shared") >= must_share(least))
    first = checkpoint(with_pivot.join(a, "key_a").join(b, "key_b").where(close).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
    known = checkpoint(compared(first, sets_of(docs, of_pairs(classes, first), words)))
    links = known.where(is_link(least)).select("a", "b")
    # without labels every document is a component of its own, and only the windows drop pairs
    labels = links.limit(0).select(F.col("a").alias("id"), F.col("b").alias("component")) if every else components(links)
    second = checkpoint(window_pairs(met, known, labels, narrow, least))
    found = links.union(compared(second, sets_of(docs, of_pairs(classes, second), words)).where(is_link(least)).select("a", "b"))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct() if every else found


def of_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    return classes.join(ends, "key", "left_semi").select("key", "id", "digest")


def window_pairs(met: DataFrame, known: DataFrame, labels: DataFrame, narrow: DataFrame, least: int) -> DataFrame:
    """a, b: pairs of a region in different components, neither the pivot, that no window
    drops. Of two different components one at least is not the pivot's, so one side of a pair
    is taken from there only; the other side lies in the same band of sizes or the next."""
    placed = met.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    of_pivot = labels.select(F.col("id").alias("pivot"), F.col("component").alias("main"))
    placed = placed.join(of_pivot, "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))
    several = placed.where("component != main").select("region").distinct()
    apart = known.select(F.col("a").alias("key"), F.col("b").alias("pivot"), distance().alias("d"))
    rest = placed.where("key != pivot").join(several, "region", "left_semi").join(apart, ["key", "pivot"], "left").join(narrow, "key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / least))).cast("long")
    own = ("key", "component", "main", "d", "n", "parts", "signs", "missed")
    rest = checkpoint(rest.select("region", *own, band.alias("band")))
    x, y = (rest.select("region", "band", *[F.col(c).alias(f"{c}_{side}") for c in own]) for side in "ab")
    x = x.where("component_a != main_a").withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    near = (
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("main_b")) | (F.col("key_a") < F.col("key_b")))
        & (F.col("d_a").isNull() | F.col("d_b").isNull() | (F.abs(F.col("d_a") - F.col("d_b")) <= 1 - least / 100 + 1e-9))
        & near_sizes(least)
    )
    both = x.join(y.withColumnsRenamed({"region": "region_b", "band": "band_b"}), (F.col("region") == F.col("region_b")) & (F.col("band") == F.col("band_b")) & near)
    ends = both.groupBy(F.greatest("key_a", "key_b").alias("a"), F.least("key_a", "key_b").alias("b"))
    return ends.agg(F.sum(in_region()).alias("shared"), F.max(must_share(least)).alias("asked")).where("shared >= asked").select("a", "b")


def class_links(docs: DataFrame, words: int, least: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (id, n, digest), the classes of equal sets that have an id (key, smallest id,
    digest, n, parts and signs), and links between keys. The key of a class is the number of one of its rows."""
    text_batches(docs.sparkSession)
    source = docs.select("id", "text")
    rows = checkpoint(document_rows(source, words, leaf_size(least))).withColumn("row", F.monotonically_increasing_id())
    base = rows.select("id", "n", "digest")
    own = rows.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    same = own.groupBy("digest")
    classes = checkpoint(same.agg(F.min("row").alias("key"), F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "parts", "signs")]))
    if least >= 100:
        return base, classes, classes.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    heads = classes.select(F.col("key").alias("id"))
    repeats = checkpoint(own.select(F.col("row").alias("id")).join(heads, "id", "left_anti"))
    sure, others = split_by(own.select("row", "leaves"), F.col("row"), repeats)
    of_heads = sure.union(others.join(heads.withColumnRenamed("id", "row"), "row", "left_semi"))
    entries = of_heads.select(F.explode("leaves").alias("region"), F.col("row").alias("key"))
    return base, classes, find_links(entries, classes, source.where(F.col("id").isNotNull() & F.col("text").isNotNull()), words, least, every)


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))


def with_components(base: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """The digest and component of each row: the smallest id of the component. Sets of one id
    are connected too."""
    own = base.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).select("id", "digest").distinct().join(classes.select("digest", "key"), "digest")
    several = own.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi")
    bridges = several.join(own, "id").select(F.col("key").alias("a"), F.col("lo").alias("b")).where("a != b")
    labels = components(checkpoint(links.union(bridges).distinct()))
    least_id = labels.join(classes.select(F.col("key").alias("id"), F.col("id").alias("smallest")), "id").groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_key = labels.join(least_id, "component").select(F.col("id").alias("key"), "component_id")
    of_digest = classes.join(of_key, "key", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    joined = base.join(of_digest, "digest", "left")
    return joined.select("digest", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id. Components only: pairs that
    are connected already are not compared."""
    return with_components(*class_links(named(docs, doc_id, text), words, least, False)).drop("digest")


def all_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """a, b, digest_a, digest_b: every link between different sets, each by the smallest id and
    the digest of the set, (a, digest_a) > (b, digest_b)."""
    _, classes, links = class_links(named(docs, doc_id, text), words, least, True)
    x, y = (classes.select(F.col("key").alias(side), F.struct("id", "digest").alias(f"of_{side}")) for side in "ab")
    ends = links.join(x, "a").join(y, "b").select(F.greatest("of_a", "of_b").alias("x"), F.least("of_a", "of_b").alias("y"))
    return ends.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.digest").alias("digest_a"), F.col("y.digest").alias("digest_b"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links. The last is the number
    of different sets, other than its own, that the row's set is linked with; its work and
    the links grow with the square of a group of near copies."""
    base, classes, links = class_links(named(docs, doc_id, text), words, least, True)
    links = checkpoint(links)
    ends = links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
    of_digest = classes.join(ends, "key").select("digest", "n_links")
    joined = with_components(base, classes, links).join(of_digest, "digest", "left")
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: int = 80) -> DataFrame:
    """The rows, with their columns, of one document of each component, that with the
    smallest id; of repeated rows of an id and text one stays, of an id with several texts
    each different text. Rows without an id stay unless their set equals that of a document
    with one; documents with the empty set all stay."""
    found = join_documents(docs, doc_id, text, words, least).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    of_id = found.agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone"))
    looked_at = checkpoint(of_id.where("gone OR rows > 1").select("id", "gone"))
    number = F.col(doc_id).cast("long")
    apart, others = split_by(docs.where(number.isNotNull()), number, looked_at.select("id"))
    gone = looked_at.where("gone").select(F.col("id").alias(fresh := fresh_name(docs, "gone_id")))
    left = others.join(gone, number == gone[fresh], "left_anti")
    return apart.unionByName(left.dropDuplicates([doc_id, text])).unionByName(docs.where(number.isNull()))
