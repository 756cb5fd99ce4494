"""Splitting oversized items at natural boundaries, by byte ranges.

Items of one range are cut where they stand. A giant item is cut in three steps: each task finds the boundaries inside one
range of bytes with a halo on both sides, and writes them to a boundary table; the tables of an item's ranges are stitched
by prefix sums over their lengths and counts (in two levels); the pieces are then emitted by offset. Neighbouring ranges
see the same bytes around the place where they meet and so choose the same anchor there without a word between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcode.functions.arrow import map_lists
from loomcode.session import cut, parallelism, spread

#: Bytes of a range, and ranges that share a first-level prefix sum.
RANGE, PREFIX_BLOCK = 1 << 18, 1024
BYTES_PER_TOKEN = 4
PIECES = "item_table string, item_key string, piece_no bigint, start_byte bigint, end_byte bigint, text string"
BOUNDARIES = "item_table string, item_key string, range_no bigint, ends array<bigint>"
NAMES = ["item_table", "item_key"]


def estimated_tokens(text: Column) -> Column:
    """floor(bytes / 4); a null text has size 0."""
    return F.coalesce(F.floor(F.octet_length(text) / BYTES_PER_TOKEN), F.lit(0))


def _aligned(data: bytes, at: int) -> int:
    """The start of the character at or before a position."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


# What stands before a cut, by preference.
_BLANK_LINE = (b"\n\n", b"\n\r\n")
_SENTENCE = (b". ", b"! ", b"? ", b"; ")
_INDENTED = (b" ", b"\t", b"}", b")", b"]", b"\n", b"\r", b"")


def _last(data: bytes, marks: tuple[bytes, ...], low: int, high: int) -> int:
    """End of the last mark that ends in (low, high], or -1."""
    return max((at + len(m) for m in marks if (at := data.rfind(m, max(0, low + 1 - len(m)), high)) >= 0), default=-1)


def boundary(data: bytes, low: int, high: int, code: bool) -> int:
    """The best place to cut in (low, high]: a blank line (in code one before unindented text, if there is any), a line
    end, the end of a sentence, a space, else the start of a character. Of equal places the last."""
    blank = at = _last(data, _BLANK_LINE, low, high)
    while code and at > low and data[at : at + 1] in _INDENTED:
        at = _last(data, _BLANK_LINE, low, at - 1)
    for found in (at, blank, _last(data, (b"\n",), low, high), _last(data, _SENTENCE, low, high), _last(data, (b" ", b"\t"), low, high)):
        if found > low:
            return found
    at = _aligned(data, high)
    return at if at > low else high


def cut_points(data: bytes, start: int, stop: int, limit: int, overlap: int, code: bool) -> list[int]:
    """Ends of the pieces of data[start:stop]. A piece reaches back ``overlap`` bytes, as far as the data goes, and has no
    more than ``limit`` bytes with that."""
    out = []
    done = start
    while done < stop:
        begin = _aligned(data, max(0, done - overlap))
        done = stop if stop - begin <= limit else boundary(data, max(done, begin + limit // 2), begin + limit, code)
        out.append(done)
    return out


def anchor(data: bytes, nominal: int, limit: int, code: bool) -> int:
    """Where the pieces of one range end and those of the next begin: the best boundary within ``limit`` bytes from the
    nominal position on."""
    return boundary(data, nominal, min(len(data), nominal + limit), code)


def items(table: DataFrame, name: str, key: str, text: str, profile: str, config: DataFrame, scope: str) -> DataFrame:
    """``item_table, item_key, content, code, n_bytes, chunk_size, chunk_overlap`` with the configuration in force for each
    row: that of its profile, else that of ``*``. Without either, or with a size below 1, a row is never split. A negative
    overlap counts as none; one that is not smaller than the size can't be kept and is an error."""
    conf = (
        config.where((F.col("scope") == scope) & (F.col("chunk_size") > 0) & F.col("profile").isNotNull())
        .groupBy("profile").agg(F.min(F.struct("chunk_size", F.greatest(F.lit(0), F.coalesce("chunk_overlap", F.lit(0))).alias("chunk_overlap"))).alias("c"))
    )
    rows = table.select(F.col(key).cast("string").alias("item_key"), F.col(text).alias("content"), F.col(profile).alias("language"))
    named = rows.join(conf.select(F.col("profile").alias("language"), F.lit(True).alias("named")), "language", "left")
    keyed = named.withColumn("profile", F.when(F.col("named"), F.col("language")).otherwise("*"))
    kept = F.col("c.chunk_overlap") < F.col("c.chunk_size")
    return keyed.join(conf, "profile").select(
        F.lit(name).alias("item_table"), "item_key", "content", F.lit(scope == "code").alias("code"), F.octet_length("content").alias("n_bytes"), F.col("c.chunk_size").alias("chunk_size"),
        F.when(kept, F.col("c.chunk_overlap")).otherwise(F.raise_error(F.lit("chunk_overlap must be smaller than chunk_size")).cast("int")).alias("chunk_overlap"),
    )


def oversized(rows: DataFrame) -> DataFrame:
    """The items above their size limit; rows without a key are left out."""
    return rows.where((F.floor(F.col("n_bytes") / BYTES_PER_TOKEN) > F.col("chunk_size")) & F.col("item_key").isNotNull())


def item_once(rows: DataFrame) -> DataFrame:
    """One row for each item: of rows that differ, the one with the smallest limit, then the greatest content. This is also
    what spreads the items over the tasks."""
    spark = rows.sparkSession
    others = F.struct(-F.col("chunk_size"), "chunk_overlap", "content", "code", "n_bytes", "chunk_size")
    parts = max(2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = rows.repartition(parts, *NAMES).groupBy(*NAMES).agg(F.max(others).alias("r"))
    return best.select(*NAMES, "r.content", "r.code", "r.n_bytes", "r.chunk_size", "r.chunk_overlap")


def _starts(ends: list[int], first: int, overlap: int, data: bytes, base: int) -> list[int]:
    """Where the pieces with these ends begin; only an item's first piece has nothing to reach back to."""
    return [first if first + base == 0 and k == 0 else _aligned(data, max(0, (ends[k - 1] if k else first) - overlap)) for k in range(len(ends))]


def _emit(table: str, key: str, data: bytes, base: int, first: int, ends: list[int], number: int, overlap: int) -> list[tuple]:
    """The pieces of a stretch of bytes that begins at ``base``; first and ends are positions in the item."""
    local = [e - base for e in ends]
    begins = _starts(local, first - base, overlap, data, base)
    return [(table, key, number + k, base + a, base + b, bytes(data[a:b]).decode("utf-8", "replace")) for k, (a, b) in enumerate(zip(begins, local, strict=True))]


def split_items(rows: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """``item_table, item_key, piece_no, start_byte, end_byte, text`` of the pieces of each oversized item.

    Pieces count from 0; each has at most ``chunk_size`` estimated tokens, and each but the first starts
    ``chunk_overlap`` tokens (and at most three bytes more) before the end of the one before it. Together they cover the
    item. Items within the limit give no piece.
    """
    # A range holds several pieces, so an anchor never lies beyond the next range.
    span = F.greatest(F.lit(range_bytes), F.col("chunk_size") * 4 * BYTES_PER_TOKEN).cast("bigint")
    sized = item_once(oversized(rows)).withColumn("span", span)

    def whole(*batch: list) -> list:
        out = []
        for table, key, content, code, size, overlap in zip(*batch, strict=True):
            data = content.encode()
            ends = cut_points(data, 0, len(data), size * BYTES_PER_TOKEN, overlap * BYTES_PER_TOKEN, code)
            out += _emit(table, key, data, 0, 0, ends, 0, overlap * BYTES_PER_TOKEN)
        return out

    small = map_lists(sized.where("n_bytes <= span").select(*NAMES, "content", "code", "chunk_size", "chunk_overlap"), whole, PIECES)
    ranges = _ranges(sized.where("n_bytes > span"))

    def emit(*batch: list) -> list:
        out = []
        for table, key, data, base, overlap, number, first, ends in zip(*batch, strict=True):
            out += _emit(table, key, data, base, first, [first + e for e in ends], number, overlap * BYTES_PER_TOKEN)
        return out

    stitched = stitch(find_boundaries(ranges))
    placed = ranges.join(stitched, [*NAMES, "range_no"]).select(*NAMES, "stretch", "base", "chunk_overlap", "first_piece", "first_byte", "ends")
    return small.unionByName(map_lists(placed, emit, PIECES))


RANGES = "item_table string, item_key string, range_no bigint, n_ranges bigint, base bigint, span bigint, n_bytes bigint, code boolean, chunk_size int, chunk_overlap int, stretch binary"


def _ranges(large: DataFrame) -> DataFrame:
    """The ranges of giant items with their halos. The bytes are slices of the row's own buffer, a batch for each few ranges,
    so nothing is encoded or held twice."""
    columns = [*NAMES, "content", "code", "n_bytes", "chunk_size", "chunk_overlap", "span"]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
            for k, row in enumerate(batch.drop_columns(["content"]).to_pylist()):
                data = texts[k].as_buffer()
                halo = (row["chunk_size"] + 2) * BYTES_PER_TOKEN
                n_ranges = -(-row["n_bytes"] // row["span"])
                for no in range(n_ranges):
                    base = max(0, no * row["span"] - halo)
                    piece = data.slice(base, min(data.size, (no + 1) * row["span"] + halo) - base).to_pybytes()
                    values = [row["item_table"], row["item_key"], no, n_ranges, base, row["span"], row["n_bytes"], row["code"], row["chunk_size"], row["chunk_overlap"], piece]
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, kinds, strict=True)], names=names)

    names = [c.split()[0] for c in RANGES.split(", ")]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    return large.select(*columns).mapInArrow(slices, RANGES)


def _range_ends(data: bytes, no: int, n_ranges: int, base: int, span: int, n_bytes: int, code: bool, size: int, overlap: int) -> list[int]:
    """Ends of a range's pieces, counted from the anchor at which the range begins."""
    limit = size * BYTES_PER_TOKEN
    begin = 0 if no == 0 else anchor(data, no * span - base, limit, code)
    end = n_bytes - base if no == n_ranges - 1 else anchor(data, (no + 1) * span - base, limit, code)
    return [e - begin for e in cut_points(data, begin, end, limit, overlap * BYTES_PER_TOKEN, code)]


def find_boundaries(ranges: DataFrame) -> DataFrame:
    """The boundary table: ``item_table, item_key, range_no, ends`` for each range; one row of numbers a range. It is written
    once and serves the prefix sums and the pieces."""
    columns = ["range_no", "n_ranges", "base", "span", "n_bytes", "code", "chunk_size", "chunk_overlap"]

    def find(tables: list, keys: list, stretches: list, *rest: list) -> list:
        return [(t, k, r[0], _range_ends(data, *r)) for t, k, data, r in zip(tables, keys, stretches, zip(*rest, strict=True), strict=True)]

    parts = max(2 * parallelism(ranges.sparkSession), int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(map_lists(ranges.repartition(parts, *NAMES, "range_no").select(*NAMES, "stretch", *columns), find, BOUNDARIES))


def stitch(boundaries: DataFrame) -> DataFrame:
    """The boundary table with ``first_piece, first_byte`` of each range: prefix sums of the counts and lengths of all ranges
    before it, first inside blocks of ranges, then over the blocks."""
    sums = boundaries.withColumn("n", F.size("ends")).withColumn("length", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))).withColumn("block", F.floor(F.col("range_no") / PREFIX_BLOCK))
    inside = Window.partitionBy(*NAMES, "block").orderBy("range_no")
    blocks = sums.groupBy(*NAMES, "block").agg(F.sum("n").alias("bn"), F.sum("length").alias("bl"))
    before = Window.partitionBy(*NAMES).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*NAMES, "block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bl").over(before), F.lit(0)).alias("l0"))
    placed = sums.withColumn("n1", F.sum("n").over(inside) - F.col("n")).withColumn("l1", F.sum("length").over(inside) - F.col("length"))
    return placed.join(blocks, [*NAMES, "block"]).select(*NAMES, "range_no", "ends", (F.col("n0") + F.col("n1")).alias("first_piece"), (F.col("l0") + F.col("l1")).alias("first_byte"))


def split_files(listing: DataFrame, chunk_size: int, chunk_overlap: int, code: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The pieces of files by path without loading any whole: ``listing`` has ``path, length`` (as from a file listing).

    Each task opens a path and reads its range and the halos by offset; the pieces are read by offset again once their
    places are known. Paths are what pyarrow's filesystems take (local, hdfs:, s3:). Items within the limit give no piece.
    """
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError("chunk_overlap must be at least 0 and smaller than chunk_size")
    halo = (chunk_size + 2) * BYTES_PER_TOKEN
    span = max(range_bytes, 4 * chunk_size * BYTES_PER_TOKEN)
    back = chunk_overlap * BYTES_PER_TOKEN
    ranges = (
        listing.where(F.floor(F.col("length") / BYTES_PER_TOKEN) > chunk_size)
        .select("path", F.col("length").cast("bigint").alias("length"))
        .withColumn("n_ranges", F.ceil(F.col("length") / span))
        .withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_ranges") - 1)))
    )

    def find(*batch: list) -> list:
        out = []
        for path, length, n_ranges, no in zip(*batch, strict=True):
            base = max(0, no * span - halo)
            data = _read(path, base, min(length, (no + 1) * span + halo) - base)
            out.append(("paths", path, no, _range_ends(data, no, n_ranges, base, span, length, code, chunk_size, chunk_overlap)))
        return out

    def emit(*batch: list) -> list:
        out = []
        for table, path, number, first, ends in zip(*batch, strict=True):
            base = max(0, first - back - BYTES_PER_TOKEN)
            data = _read(path, base, first + ends[-1] - base) if ends else b""
            out += _emit(table, path, data, base, first, [first + e for e in ends], number, back)
        return out

    stitched = stitch(cut(map_lists(spread(ranges), find, BOUNDARIES)))
    return map_lists(stitched.select(*NAMES, "first_piece", "first_byte", "ends"), emit, PIECES)


def _read(path: str, base: int, size: int) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_file(name) as source:
        return source.read_at(size, base)


def project_items(files: DataFrame, documents: DataFrame, config: DataFrame) -> DataFrame:
    """The items of this project: files by language under the code profiles, documents by lang under the text profiles."""
    return items(files, "files", "path", "content", "language", config, "code").unionByName(items(documents, "documents", "doc_id", "text", "lang", config, "text"))
