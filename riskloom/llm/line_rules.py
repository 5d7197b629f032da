"""Quality rules over documents and over the lines that documents of a host share.

Rules inside a document are array expressions over its words and lines. Across documents,
normalised lines are hashed and the distinct documents that hold each line are counted
for each host; lines in more documents than the limit allows are taken out of the texts
(`remove_lines` returns these); a document is rejected if too little is left of it. The limit
is a number of documents, the same for hosts of every size. Exact copies (equal texts) count as
one document of their host, so that copying alone makes no line a shared one.

Only texts that may have such a line travel to the list of theirs: a filter of fixed size says
which, and the join that follows is exact.

All of it is DataFrame functions. The line counts are summed before each shuffle; nothing
is collected for a line, a host or a group of copies.

Defined results: a null or empty text has no words, fails the base rules and is not kept;
null hosts are one host; equal rows get equal results; lines without a word are never
counted or removed; texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import checkpoint

#: A line is removed from a host's documents if it stands in more distinct documents of
#: the host than this.
MIN_DOCUMENTS = 20
#: Bits of the filter of texts with a shared line.
FILTER_BITS = 1 << 23
#: A document is rejected if less than this share of its words is left.
MIN_LEFT = 0.3
MIN_WORDS = 50

BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: the value becomes a lambda's argument."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that stand in the text twice or more. Windows are
    compared by 64-bit hash; texts without an equal pair, which the distinct count shows,
    go no further."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.get(s, j)["h"] == x["h"]
            twice = F.filter(s, lambda x, j: (j > 0) & F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def union_length(at: Column) -> Column:
            step = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return bind(placed, lambda s: bind(starts(s), union_length))

    def of(w: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(
            bind(window, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        )

    return bind(words, of)


def with_base_rules(docs: DataFrame) -> DataFrame:
    """Adds the base counts to a frame with a `text` column that holds no nulls."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    counts = bind(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    return docs.select(
        "*",
        counts.alias("counts"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def normal(line: Column) -> Column:
    """A line as it is compared: in lower case, single blanks between its words."""
    return F.trim(F.regexp_replace(F.lower(line), f"[{BLANK}]+", " "))


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of a host and each different normalised line with a
    word in it."""
    lines = docs.select(*TEXT_KEY, F.explode(F.split("text", "\n")).alias("line")).withColumn("line", normal(F.col("line"))).where("line != ''")
    return lines.select(*TEXT_KEY, F.xxhash64("line").alias("line_hash")).distinct()


#: A text of a host, by two independent hashes.
TEXT_KEY = ["host", "text_hash", "text_check"]


def with_text_key(docs: DataFrame, text: str, host: str) -> DataFrame:
    """The rows with the columns of TEXT_KEY; their own columns become the struct `row`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    return rows.withColumns({"text_hash": F.xxhash64("text"), "text_check": F.crc32(F.col("text").cast("binary"))})


def shared_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """(host, line hash) of the lines above the limit."""
    return lines.groupBy("host", "line_hash").agg(F.count("*").alias("held_by")).where(F.col("held_by") > min_documents).select("host", "line_hash")


def in_sorted(values: Column, bits: Column, x: Column) -> Column:
    """Whether x is in a sorted array, by halving; `bits` counts down from those of its size to 0."""

    def further(at: Column, bit: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((to < F.size(values)) & (F.get(values, to) <= x), to).otherwise(at)

    return F.get(values, F.aggregate(bits, F.lit(0), further)) == x


def without(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are in the sorted array; the others as they
    are, in their order."""

    def of(values: Column, bits: Column) -> Column:
        stays = lambda line: bind(normal(line), lambda x: (x == "") | ~in_sorted(values, bits, F.xxhash64(x)))
        return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")

    bits = F.sequence(F.ceil(F.log2(F.size(gone))).cast("int"), F.lit(0), F.lit(-1))
    return bind(F.struct(gone.alias("values"), bits.alias("bits")), lambda g: of(g["values"], g["bits"]))


def lines_to_lose(docs: DataFrame, min_documents: int) -> DataFrame:
    """TEXT_KEY and `gone`, the sorted hashes of the shared lines, of the texts with any."""
    lines = checkpoint(line_table(docs))
    found = lines.join(shared_lines(lines, min_documents), ["host", "line_hash"], "left_semi")
    return checkpoint(found.groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_list("line_hash")).alias("gone")))


def with_possible(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Adds `possible`: true for all rows whose text is in `gone`, and for few others while
    these are few next to FILTER_BITS. The filter is 1 MB whatever the tables."""
    place = F.pmod(F.col("text_hash"), F.lit(FILTER_BITS)) + 1  # bitmap numbers and positions count from 1
    maps = gone.groupBy(F.bitmap_bucket_number(place).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    numbered = rows.withColumn("number", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "number", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return numbered.withColumn("possible", held).drop("number", "bits")


def with_cleaned(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Adds `cleaned`, the text without the lines that its host's documents share, null if it
    has none, to rows with TEXT_KEY and `text`, which goes."""
    rows = with_possible(rows, gone).withColumn("text", F.when(F.col("possible"), F.col("text")))
    cleaned = F.when(F.col("gone").isNotNull(), without(F.col("text"), F.col("gone")))
    return rows.join(gone, TEXT_KEY, "left").withColumn("cleaned", cleaned).drop("gone", "text", "possible")


def remove_lines(docs: DataFrame, text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The rows, with their columns, of the documents; texts without the lines that their
    host's documents share."""
    keyed = with_text_key(docs, text, host)
    rows = with_cleaned(keyed, lines_to_lose(keyed, min_documents))
    own = {c: F.col("row")[c] for c in docs.columns}
    return rows.select(*[(F.coalesce("cleaned", v) if c.lower() == text.lower() else v).alias(c) for c, v in own.items()])


def apply_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, min_left: float = MIN_LEFT
) -> DataFrame:
    """One row per input row: doc_id, n_words, the base counts, `base_failed`, `kept`, and
    the words that the cleaned text has less."""
    source = with_text_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host")), "text", "host")
    # the texts are read twice, for their lines and for their rules
    source = source.select(F.col("row.doc_id").alias("doc_id"), "text", *TEXT_KEY)
    base = with_base_rules(source).withColumn("n_words", F.col("counts.n_words")).withColumn("n_repeat_words", F.col("counts.n_repeat_words")).drop("counts")
    joined = with_cleaned(base, lines_to_lose(source, min_documents))
    n_left = F.when(F.col("cleaned").isNull(), F.col("n_words")).otherwise(F.size(words_of(F.col("cleaned"))).cast("long"))
    joined = joined.withColumn("n_removed_words", F.col("n_words") - n_left)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_removed_words"
    )
