"""Readers: code samples, split lists, catalogues, vectors, tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.taint import sink_category
from ..schemas import SCHEMAS
from . import versions

_LOOSE = "func string, code string, target string, label string, idx long, project string, commit_id string"


def training_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Code samples, one object a line; a malformed line is an error."""
    return spark.read.schema(SCHEMAS["code_samples"]).option("mode", "FAILFAST").json(path)


#: What is said of a line or file that gives no row.
NOT_JSON, NOT_OBJECT, BLANK = "not JSON", "not an object", "blank"


def _told(text: str, arrays: bool = False) -> Column:
    """Why a text gives no row, null where it does: an object, or an array if ``arrays``, from its first to its last
    character. (The parser alone takes a text whose beginning it can read.)"""
    good, whole = F.try_parse_json(text), strip(F.col(text))
    kind = F.schema_of_variant(good)
    wanted = kind.startswith("OBJECT") | kind.startswith("ARRAY") if arrays else kind.startswith("OBJECT")
    told = F.when(whole == "", BLANK).when(good.isNull(), NOT_JSON).when(~wanted, NOT_OBJECT)
    return told.when(~(whole.endswith("}") | whole.endswith("]")), NOT_JSON)


def _texts(spark: SparkSession, path: str, **options) -> DataFrame:
    """value, file, block: the raw lines (or files) with where they come from."""
    return spark.read.text(path, **options).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _repaired(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a missing opening brace added, and what is wrong with those that give no row."""
    line = strip(F.col("value"))
    raw = _texts(spark, path).withColumn("raw", F.col("value"))
    mended = raw.withColumn("value", F.when((line == "") | line.startswith("{"), line).otherwise(F.concat(F.lit("{"), line)))
    return mended.withColumn("reason", _told("value"))


def repairing_jsonl(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """func, target: blank lines skipped, a missing opening brace added, bad lines dropped (``repairing_rejects`` has them);
    ``limit`` counts good rows."""
    good = _repaired(spark, path).filter(F.col("reason").isNull()).withColumn("__o", F.from_json("value", _LOOSE))
    rows = good.select(F.coalesce("__o.func", F.lit("")).alias("func"), F.coalesce(F.col("__o.target").try_cast("int"), F.lit(0)).alias("target"))
    return rows.limit(limit) if limit else rows


def _rejects(lines: DataFrame, text: str) -> DataFrame:
    """file, block, value, reason: what gave no row, where its file's block begins, and why."""
    return lines.select("file", "block", F.col(text).alias("value"), "reason").filter(F.col("reason").isNotNull())


def repairing_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``repairing_jsonl`` leaves out: with its rows, every raw line once."""
    return _rejects(_repaired(spark, path), "raw")


def catalogue_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``catalogue_jsonl`` leaves out; none where there is no file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "file string, block long, value string, reason string")
    return _rejects(_texts(spark, path).withColumn("reason", _told("value")), "value")


def template_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The files ``template_catalogue`` leaves out, as a whole; a file of no bytes holds nothing that could be left out."""
    files = _texts(spark, path, wholetext=True, pathGlobFilter="*.json")
    return _rejects(files.withColumn("reason", _told("value", True)), "value")


def batch_jsonl(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """line_no, code, label: ``limit`` counts raw lines, blank ones too; the code is ``func`` or ``code``, the label
    ``target`` or ``label`` or -1; rows without code are left out; a malformed line is an error."""
    lines = numbered_lines(spark, path)
    if limit:
        lines = lines.filter(F.col("line_no") < limit)
    lines = lines.filter(strip(F.col("value")) != "")
    o = F.from_json("value", _LOOSE, {"mode": "FAILFAST"})
    rows = lines.withColumn("__o", o).select(
        "line_no", F.coalesce("__o.func", "__o.code", F.lit("")).alias("code"),
        F.coalesce(F.col("__o.target").try_cast("int"), F.col("__o.label").try_cast("int"), F.lit(-1)).alias("label"),
    )
    return rows.filter(strip(F.col("code")) != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), value, in the order of files' paths. Blocks of files are numbered by their line counts, so no
    task sees all lines; what one task sorts is a row a block."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    marked = lines.withColumn("__id", F.monotonically_increasing_id())
    sizes = marked.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    before = F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    begin = sizes.select("__file", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__begin"))
    return marked.join(begin, ["__file", "__block"]).select((F.col("__begin") + F.col("__id") - F.col("__first")).alias("line_no"), "value")


def json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file that is one array of objects."""
    return spark.read.schema(schema or SCHEMAS["code_samples"]).option("multiLine", True).json(path)


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct whole numbers, one a line."""
    return spark.read.text(path).select(strip(F.col("value")).cast("long").alias("idx")).distinct()


def template_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Template files (an object or an array each), in order of their paths; a file that does not parse is skipped."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.input_file_name().alias("file"), F.col("value"))
    objects = files.filter(_told("value", True).isNull())
    many = F.from_json("value", T.ArrayType(SCHEMAS["template_catalogue"]))  # a lone object reads as an array of one
    rows = objects.select("file", F.posexplode(many).alias("pos", "t")).orderBy("file", "pos")
    return _with_defaults(rows.select("t.*"))


def catalogue_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue entries, one object a line; bad lines are skipped, a missing file has no rows."""
    schema = SCHEMAS["template_catalogue"]
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).filter(_told("value").isNull())
    return _with_defaults(lines.select(F.from_json("value", schema).alias("t")).select("t.*"))


def _with_defaults(rows: DataFrame) -> DataFrame:
    texts = {c: F.coalesce(c, F.lit("c" if c == "language" else "")) for c in rows.columns if rows.schema[c].dataType == T.StringType()}
    empty = F.array().cast("array<string>")
    return rows.withColumns(texts | {"timeout_sec": F.coalesce("timeout_sec", F.lit(30)), "tags": F.coalesce("tags", empty), "expected_signals": F.coalesce("expected_signals", empty)})


def path_exists(spark: SparkSession, path: str) -> bool:
    """By the file system of the path, so that stores only Spark reads are asked as well."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def inline(spark: SparkSession, code: str) -> DataFrame:
    return spark.createDataFrame([(0, code)], "sample_id long, code string")


def source_file(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one sample."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("sample_id"), F.col("value").alias("code"))


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their metadata in one table: the newest version, or plain Parquet where nothing was published."""
    found = versions.current(spark, path)
    return versions.rows_of(spark, path, found) if found else spark.read.parquet(path)


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vector: lines of a word and its numbers; lines of two fields or fewer (headings) are skipped."""
    parts = F.split(strip(F.col("value")), " ")
    rows = spark.read.text(path).withColumn("p", parts).filter(F.size("p") > 2)
    return rows.select(F.get("p", 0).alias("word"), F.slice("p", 2, 1 << 30).cast("array<float>").alias("vector"))


SECTIONS = {"===TAINT_SOURCES===": "sources", "===TAINT_SINKS===": "sinks", "===CALL_GRAPH===": "callgraph", "===FUNCTIONS===": "functions"}


def graph_tool_rows(outputs: DataFrame, id_name: str = "sample_id", output: str = "output") -> DataFrame:
    """sample_id, line_no, section, parts: the fielded lines of a graph tool's output under their section headings.

    The section of a line is that of the last heading before it, found inside the row's own array: no window.
    """
    lines = F.transform(F.split(strip(F.col(output)), "\n"), strip)
    headings = F.array(*[F.lit(h) for h in SECTIONS])
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    flat = outputs.select(F.col(id_name).alias("sample_id"), lines.alias("ls")).select("sample_id", "ls", F.posexplode(F.filter(F.transform("ls", lambda x, i: F.struct(F.when(F.array_contains(headings, x), F.element_at(names, x)).alias("section"), i.alias("i"))), lambda s: s["section"].isNotNull())).alias("h", "s"))
    ends = Window.partitionBy("sample_id").orderBy("h")
    spans = flat.withColumn("until", F.coalesce(F.lead("s.i").over(ends), F.size("ls")))
    body = spans.select("sample_id", "s.section", F.explode(F.when(F.col("until") - F.col("s.i") > 1, F.sequence(F.col("s.i") + 1, F.col("until") - 1)).otherwise(F.array().cast("array<int>"))).alias("line_no"), "ls")
    rows = body.select("sample_id", "line_no", "section", F.split(F.get("ls", F.col("line_no")), r"\|").alias("parts"))
    least = F.when(F.col("section").isin("sources", "sinks"), 2).otherwise(3)
    return rows.filter(F.size("parts") >= least)


def graph_tool_paths(rows: DataFrame) -> DataFrame:
    """Every source with every sink of a sample; this form has neither deduplication nor a cap."""
    def hits(section: str, name: str, line: str) -> DataFrame:
        return rows.filter(F.col("section") == section).select("sample_id", F.get("parts", 0).alias(name), F.get("parts", 1).cast("int").alias(line))

    return hits("sources", "source_func", "source_line").join(hits("sinks", "sink_func", "sink_line"), "sample_id").withColumn("sink_category", sink_category(F.col("sink_func")))


def catalogue(spark: SparkSession, templates: str, entries: str) -> DataFrame:
    """Template files followed by catalogue lines; nothing is deduplicated."""
    return template_catalogue(spark, templates).unionByName(catalogue_jsonl(spark, entries))
