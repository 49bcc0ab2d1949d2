"""Quoted CSV of any size: read by byte ranges although quoted values hold line breaks, and written as one ordered file."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text
from veriloom.operators.contracts import ContractError
from veriloom.operators.ranking import ROW_BITS, running_totals
from veriloom.session import materialised

#: Ranges whose starting states are sent to all tasks; those of more are joined by shuffle.
MOST_SENT = 1 << 20

_RANGE = ("file", "at", "length")
_SPLIT_KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@contextmanager
def _split_by(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Files are cut into ranges of `most` bytes, or as the session has it."""
    before = {k: spark.conf.get(k, None) for k in _SPLIT_KEYS}
    if most:
        spark.conf.set(_SPLIT_KEYS[0], str(most))
        spark.conf.set(_SPLIT_KEYS[1], str(max(1, most // 4)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with the range of bytes that holds their first one; lines of a range come in order, in one task."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), meta["file_block_length"].alias("length"), F.col("value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(range, rows) of the consecutive rows of one range."""
    names, places = batch.column("file"), batch.column("at").to_numpy()
    if not len(places):
        return
    change = (places[1:] != places[:-1]) | pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(places)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield tuple(batch.column(c)[a].as_py() for c in _RANGE), batch.slice(a, b - a)


def _quotes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quotes in each line, and whether it holds anything at all."""
    blank = pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
    return pc.count_substring(values, '"').to_numpy().astype(np.int64), ~blank


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each range, and the records that start in it if it starts outside a value (even) or inside one (odd)."""
    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for key, rows in _runs(batch):
            total = held.setdefault(key, [0, 0, 0])
            quotes, full = _quotes(rows.column("value"))
            open_ = (total[0] + np.cumsum(quotes) - quotes) & 1
            total[1] += int((full & (open_ == 0)).sum())
            total[2] += int((full & (open_ == 1)).sum())
            total[0] += int(quotes.sum())
    columns = list(zip(*[(*k, *v) for k, v in held.items()], strict=True)) or [[]] * 6
    kinds = (pa.string(), *[pa.int64()] * 5)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*_RANGE, "quotes", "even", "odd"])


def _states(lines: DataFrame) -> DataFrame:
    """(file, at, length, inside, first, of_file, headers): whether a range starts inside a value, the numbers of the first
    record that starts in it and of its file's first record, and the files with records up to its own."""
    counts = materialised(lines.mapInArrow(_count, "file string, at long, length long, quotes long, even long, odd long"))
    upto = running_totals(counts, ["file"], "at", {"quotes_upto": "quotes"})
    inside = (F.col("quotes_upto") - F.col("quotes")) % 2 == 1
    placed = upto.select(*_RANGE, "quotes_upto", inside.alias("inside"), F.when(inside, F.col("odd")).otherwise(F.col("even")).alias("starts"), F.struct("file", "at").alias("place"))
    last = placed.groupBy("file").agg(F.max_by("quotes_upto", "at").alias("quotes"))
    if open_ := last.where("quotes % 2 = 1").select("file").head(1):
        raise ContractError(f"a quoted value of {open_[0][0]} is never closed")
    numbered = running_totals(placed, (), "place", {"upto": "starts"}).withColumn("first", F.col("upto") - F.col("starts"))
    files = numbered.groupBy("file").agg(F.min("first").alias("of_file"), (F.sum("starts") > 0).cast("int").alias("headed"))
    files = running_totals(files, (), "file", {"headers": "headed"}).select(F.col("file").alias("__file"), "of_file", "headers")
    return materialised(numbered.join(files, F.col("file") == F.col("__file")).select(*_RANGE, "inside", "first", "of_file", "headers"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, of_file, headers, at, piece, whole) of the records of each range; one that another range begins or ends is a
    piece."""
    here, held = None, []
    state = {"number": 0, "of_file": 0, "headers": 0, "open": False, "begun": False}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 4, pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["number", "of_file", "headers", "at", "piece", "whole"])

    def closed(whole: bool) -> list[tuple]:
        out = [(state["number"], state["of_file"], state["headers"], here[1], "\n".join(held), whole and state["begun"])] if held else []
        held.clear()
        return out

    for batch in batches:
        out: list[tuple] = []
        for key, rows in _runs(batch):
            if key != here:
                out += closed(False)
                here = key
                inside, first, of_file, headers = (rows.column(c)[0].as_py() for c in ("inside", "first", "of_file", "headers"))
                if first is None:
                    raise ContractError(f"{key} was no range when quotes were counted; set spark.sql.files.minPartitionNum")
                state |= {"number": first - 1, "of_file": of_file, "headers": headers, "open": inside, "begun": False}
            quotes, full = _quotes(rows.column("value"))
            for line, n, is_full in zip(rows.column("value").to_pylist(), quotes.tolist(), full.tolist(), strict=True):
                if not state["open"]:
                    if not is_full:
                        continue
                    state["number"] += 1
                    state["begun"] = True
                held.append(line)
                state["open"] ^= n & 1 == 1
                if not state["open"]:
                    out += closed(True)
        yield batch_of(out)
    yield batch_of(closed(False))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, record) of CSV files in the order of their names: the text of each record, with its line breaks; ordinals are
    0, 1, ... without gaps over all files, and null for the header that each file begins with.

    Two passes over ranges of bytes, as Spark cuts files: the first counts quotes, whose sums over the ranges before say
    whether a range starts inside a value; the second cuts records where the count is even, and joins the few that
    lie over a border. Quotes stand around whole values and are doubled inside them. Blank lines between records do not
    count, a carriage return at a record's end goes; a value that is never closed is an error. Records are never gathered but
    for the pieces of one.
    """
    lines = _lines(spark, path)
    states = _states(lines)
    sent = states.select(*[F.col(c).alias(f"__{c}") for c in _RANGE], "inside", "first", "of_file", "headers")
    same = (F.col("file") == F.col("__file")) & (F.col("at") == F.col("__at")) & (F.col("length") == F.col("__length"))
    if states.count() <= MOST_SENT:
        told = lines.join(F.broadcast(sent), same, "left")  # keeps the lines' order
    else:
        told = lines.withColumn("line", F.monotonically_increasing_id()).join(sent, same, "left").repartition("file", "at").sortWithinPartitions("file", "at", "line")
    found = told.select(*_RANGE, "value", "inside", "first", "of_file", "headers").mapInArrow(_records, "number long, of_file long, headers long, at long, piece string, whole boolean")
    same_record = ("number", "of_file", "headers")
    pieces = found.where("not whole").groupBy(*same_record).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    whole = found.where("whole").select(*same_record, "piece").unionByName(pieces.select(*same_record, F.array_join(F.col("p.piece"), "\n").alias("piece")))
    ordinal = F.when(F.col("number") != F.col("of_file"), F.col("number") - F.col("headers"))
    return whole.select(ordinal.alias("ordinal"), F.regexp_replace("piece", r"\r\z", "").alias("record"))


def read_csv(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Rows of quoted CSV files, all columns as strings, and their `ordinal`. All files must have one header, and all
    records its number of values. With `split_bytes` files are cut into ranges of that size and the records are written
    once. An unnamed column is called ""."""
    with _split_by(spark, split_bytes):
        records = read_records(spark, path)
        if split_bytes:
            records = materialised(records)
        heads = [r[0].removeprefix("\ufeff") for r in records.where("ordinal is null").select("record").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ContractError("the files have different headers" if heads else f"{path} has no header")
    names = next(csv.reader(io.StringIO(heads[0], newline="")))
    if len(set(names)) < len(names) or "ordinal" in names:
        raise ContractError(f"columns repeat: {names}")
    rows = records.where("ordinal is not null").withColumn("v", _values("record", len(names)))
    return rows.select("ordinal", *[F.col("v")[i].alias(x) for i, x in enumerate(names)])


#: A comma and the value after it: whole in quotes, or without any. Java runs possessive loops without recursion.
_VALUE = r',("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'


def _values(record: str, n: int) -> Column:
    """The values of a record of n, byte for byte: one in quotes is never null, one of nothing is. Any other record is an error.
    Spark's own parser loses NUL characters and takes an empty value in quotes for a null."""
    led = F.concat(F.lit(","), F.col(record))

    def opened(raw: Column) -> Column:
        held = F.aggregate(raw, F.lit(0), lambda a, v: a + F.length(v) + 1)
        values = F.transform(raw, lambda v: F.when(v.startswith('"'), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).when(v != "", v))
        wrong = F.raise_error(F.concat(F.lit(f"Malformed CSV record, not of {n} values: "), F.substring(record, 1, 200)))
        return F.when((F.size(raw) == n) & (held == F.length(led)), values).otherwise(wrong)

    return text.let(F.regexp_extract_all(led, F.lit(_VALUE), F.lit(1)), opened)


def csv_lines(columns: Sequence[str], quote_all: bool = False) -> Column:
    """A row as a CSV record that `read_csv` reads as it was: white space and line breaks stay, a null is nothing at all, an empty
    text is in quotes. A row of one null would be a blank line, so it is an empty text."""

    def value(name: str) -> Column:
        v = F.col(f"`{name.replace('`', '``')}`").cast("string")
        inside = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        kept = inside if quote_all else F.when((v == "") | v.rlike('[",\\r\\n]'), inside).otherwise(v)
        return F.coalesce(kept, F.lit("" if len(columns) > 1 else '""'))

    return F.concat_ws(",", *[value(c) for c in columns])


def csv_header(columns: Sequence[str], quote_all: bool = False) -> str:
    head = io.StringIO(newline="")
    csv.writer(head, lineterminator="\n", quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL).writerow(columns)
    return head.getvalue()


def write_csv(df: DataFrame, folder: str, files: int, order: str) -> None:
    """About `files` CSV files by ranges of `order`, sorted, each with a header and all values but nulls in quotes."""
    head = csv_header(df.columns, quote_all=True).removesuffix("\n")
    if df.isEmpty():
        df.sparkSession.createDataFrame([(head,)], "line string").write.option("lineSep", "\n").text(folder)
        return
    placed = df.repartitionByRange(files, order).sortWithinPartitions(order).select(csv_lines(df.columns, quote_all=True).alias("line"), F.monotonically_increasing_id().alias("at"))
    first = F.col("at").bitwiseAND((1 << ROW_BITS) - 1) == 0  # the first row of its task
    placed.select(F.when(first, F.concat(F.lit(f"{head}\n"), "line")).otherwise(F.col("line")).alias("line")).write.option("lineSep", "\n").text(folder)


def _can_concat(system: object) -> bool:
    """Whether a file system joins files without reading them."""
    return system.getScheme() == "hdfs"


def write_ordered_csv(df: DataFrame, path: str, ordinal: str = "ordinal") -> str:
    """One CSV file, `path`, with a header and the rows in the order of `ordinal`, which is left out.

    Tasks write ranges of rows, sorted, and the file system joins their files: by `concat` where it can, else by copying
    bytes through the driver, a buffer at a time. The whole file is then renamed to `path`, which must not exist; until then
    nothing is there. The bytes are those of one task's output.
    """
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    columns = [c for c in df.columns if c != ordinal]
    df.repartitionByRange(ordinal).sortWithinPartitions(ordinal).select(csv_lines(columns).alias("line")).write.option("lineSep", "\n").text(f"{staging}/parts")
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    system, conf = place.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()
    whole = hadoop.fs.Path(f"{staging}/whole")
    parts = sorted((s.getPath() for s in system.listStatus(hadoop.fs.Path(f"{staging}/parts")) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = system.create(whole, False)
    try:
        out.write(bytearray(csv_header(columns).encode()))
        for part in [] if _can_concat(system) else parts:
            source = system.open(part)
            hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    finally:
        out.close()
    if _can_concat(system) and parts:
        sources = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts))
        for i, part in enumerate(parts):
            sources[i] = part
        system.concat(whole, sources)
    if system.exists(place) or not system.rename(whole, place):
        raise ContractError(f"{path} exists or cannot be published")
    system.delete(hadoop.fs.Path(staging), True)
    return path
