"""Shared plumbing of the training-data operators.

``text_map`` and ``text_filter`` push one text column through an Arrow-batched Python function while bounding how much
of it is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Texts handed to a Python function at once: at most this many, and about this many characters.
SLICE_ROWS, SLICE_CHARS = 256, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as LONG, JVM-side; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def decoded(texts: pa.Array) -> list[str | None]:
    """Texts of a column; where bytes are not valid UTF-8 (Parquet does not check) they are read as U+FFFD."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(offset, texts) runs of a batch, so that a batch of long texts is not unpacked at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and (held + n > SLICE_CHARS or i - begin >= SLICE_ROWS):
            yield begin, decoded(texts.slice(begin, i - begin))
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, decoded(texts.slice(begin))


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
        T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return simple[kind]


def text_map(
    docs: DataFrame,
    text: Column,
    carry: Sequence[Column],
    fields: str,
    make: Callable[[], Callable[[list[str | None]], Sequence[Sequence]]],
) -> DataFrame:
    """One output row per row of ``docs``: the ``carry`` columns, then ``fields`` (a DDL string).

    ``make()`` runs once per task and returns a function from a list of texts to one sequence of values per
    field. No shuffle: the result keeps the partitioning of ``docs``. Other columns of ``docs`` are pruned.
    """
    picked = docs.select(*carry, text.cast("string").alias("__text"))
    added = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    fields_out = picked.schema.fields[:-1] + added.fields
    types = [arrow_type(f.dataType) for f in added.fields]
    names = [f"c{i}" for i in range(len(fields_out))]  # a carried name may hold a dot
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, fields_out, strict=True)])
    picked = picked.toDF(*[f"t{i}" for i in range(len(picked.columns))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            last = batch.num_columns - 1
            for at, some in slices(batch.column(last)):
                columns = [batch.column(i).slice(at, len(some)) for i in range(last)]
                columns += [pa.array(v, t) for v, t in zip(score(some), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return picked.mapInArrow(run, schema).toDF(*[f.name for f in fields_out])


def text_filter(
    docs: DataFrame, text_name: str, make: Callable[[], Callable[[list[str | None]], Sequence[bool]]]
) -> DataFrame:
    """Rows of ``docs`` whose text passes; all columns stay as they are, nothing is shuffled or joined."""
    at_text, names = docs.columns.index(text_name), docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # a name may hold a dot

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            for at, some in slices(batch.column(at_text)):
                part = batch.slice(at, len(some))
                yield part.filter(pa.array([bool(x) for x in passes(some)], pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def quoted(name: str) -> str:
    """A column's name as an expression, also where it holds a dot."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fresh_prefix(df: DataFrame, prefix: str, names: Sequence[str]) -> str:
    """``prefix``, or with underscores before it until no column of ``df`` is called so plus one of ``names``."""
    taken = {c.lower() for c in df.columns}
    while any((prefix + n).lower() in taken for n in names):
        prefix = "_" + prefix
    return prefix
