"""Search over a written table with a trigram bitmap for each of its files.

A file's bitmap has a bit for each hashed trigram of its rows' texts. A term can only stand
in files that have the bits of all its trigrams; the others are not read. The exact test
follows on what is read, so a chance bit costs time and no result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.views import row_text, search_predicate

#: Bits of a file's bitmap, in rows of Spark's bitmap size (32,768 bits each).
BITS, BUCKET = 1 << 20, 1 << 15
#: Multiplier that spreads the code points of a trigram over the bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Letters looked at together, and bitmaps that a task holds at once.
CHUNK, OPEN_FILES = 1 << 18, 8


def trigrams(text: Column) -> Column:
    """Array of the three-character pieces of a text; none if it is shorter."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(letters) - 2, F.lit(0))
    first, second, third = (F.slice(letters, i, n) for i in (1, 2, 3))  # a text is split a few times, not for each piece
    return F.zip_with(F.zip_with(first, second, lambda a, b: F.concat(a, b)), third, lambda a, b: F.concat(a, b))


def trigram_bits(letters: np.ndarray) -> np.ndarray:
    """The bit of each three code points that follow each other."""
    x = letters.astype(np.uint64)
    key = ((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]) * MIX
    return (((key ^ (key >> np.uint64(32))) * MIX) >> np.uint64(44)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _add_texts(bits: np.ndarray, texts: pa.Array) -> None:
    """Sets the bits of all trigrams inside the texts, a bounded number of letters at a time."""
    letters = code_points("".join(texts.to_pylist()))
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    inside = np.ones(max(0, len(letters) - 2), dtype=bool)
    for over in (ends - 1, ends - 2):  # a piece that starts here runs over the end of its text
        inside[over[(over >= 0) & (over < len(inside))]] = False
    for s in range(0, len(inside), CHUNK):
        bits[trigram_bits(letters[s : s + CHUNK + 2])[inside[s : s + CHUNK]]] = True


def _bitmap_rows(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(file, number, bits) of the bitmaps that have a bit set, in the layout of Spark's own."""
    rows = []
    for file, bits in found.items():
        packed = np.packbits(bits, bitorder="little").reshape(-1, BUCKET // 8)
        rows += [(file, int(i) + 1, packed[i].tobytes()) for i in np.flatnonzero(packed.any(axis=1))]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], names=["file", "number", "bits"])


def file_bitmaps(batches):
    """(file, number, bits) of batches of (file, text): a file's rows mostly follow each other, so few
    bitmaps are held at once; a file that comes again gets another row."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        files = batch.column(0).dictionary_encode()
        texts = batch.column(1)
        for i, file in enumerate(files.dictionary.to_pylist()):
            if file not in found:
                if len(found) == OPEN_FILES:
                    yield _bitmap_rows(found)
                    found = {}
                found[file] = np.zeros(BITS, dtype=bool)
            _add_texts(found[file], texts if len(files.dictionary) == 1 else texts.filter(pc.equal(files.indices, i)))
    yield _bitmap_rows(found)


def write_indexed(df: DataFrame, path: str, cluster_by: Sequence[str] = (), files: int | None = None) -> None:
    """Writes the table (``path/data``), rows with like values of ``cluster_by`` in the same files,
    and the bitmaps of its files (``path/index``: file, number, bits)."""
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, *cluster_by) if cluster_by else df).write.mode("overwrite").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    texts = data.select(F.col("_metadata.file_name").alias("file"), row_text(data).alias("text"))
    # each task makes the bitmaps of its files: the shuffle carries bitmaps, not trigrams
    bits = texts.mapInArrow(file_bitmaps, "file string, number long, bits binary")
    index = bits.groupBy("file", "number").agg(F.bitmap_or_agg("bits").alias("bits"))
    index.write.mode("overwrite").parquet(f"{path}/index")


def candidate_files(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Files whose bitmap has all trigrams of the term (file)."""
    index = spark.read.parquet(f"{path}/index")
    wanted = spark.range(1).select(F.explode(F.array_distinct(trigrams(F.lower(F.trim(F.lit(term)))))).alias("t"))
    places = sorted({divmod(int(trigram_bits(code_points(r["t"]))[0]), BUCKET) for r in wanted.collect()})  # as many as the term has letters
    places = [(bucket + 1, bit) for bucket, bit in places]
    if not places:
        return index.select("file").distinct()
    has = []
    for number, bit in places:
        byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
        has.append(((F.col("number") == number) & (F.shiftright(byte, bit % 8).bitwiseAND(F.lit(1)) == 1)).cast("int"))
    found = index.where(F.col("number").isin(sorted({n for n, _ in places}))).groupBy("file").agg(F.sum(sum(has[1:], has[0])).alias("k"))
    return found.where(F.col("k") == len(places)).select("file")


def search_indexed(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The rows whose text has the term, from the files that may have it. The names of these
    files come to the driver, as those of any scan do."""
    files = sorted(r["file"] for r in candidate_files(spark, path, term).collect())
    data = spark.read.parquet(f"{path}/data")
    if not files:
        return data.where(F.lit(False))
    some = spark.read.schema(data.schema).parquet(*[f"{path}/data/{f}" for f in files])
    return some.where(search_predicate(some, term))
