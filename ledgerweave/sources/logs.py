"""Session logs: trees of JSONL files, as <project>/<session>.jsonl and <project>/<session>/subagents/**.jsonl.

A file is read as one row, so that line numbers are exact and a file with invalid UTF-8 can be skipped as a
whole. A line counts as a record only if it is one JSON object whose known fields have their types: text
fields are strings or null, isSidechain is a boolean if it's there, token counts are whole and not negative.
Two objects on one line and a top-level array are rejected like any other malformed line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions import time as ft
from ledgerweave.functions.models import UNIT
from ledgerweave.sources.scratch import new_folder

COUNTS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
USAGE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
RECORD = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("isSidechain", T.BooleanType()),
        T.StructField("message", T.StructType([T.StructField("id", T.StringType()), T.StructField("model", T.StringType()), T.StructField("usage", USAGE)])),
        T.StructField("costUSD", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("entrypoint", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)
#: What from_json gives as the text of a number, a boolean, an object or an array; a text may look like that, too.
NO_TEXT = r"^([{\[]|true$|false$|[-+]?[0-9.]+([eE][-+]?[0-9]+)?$|[-+]?(NaN|INF|Infinity)$)"
#: What a task reads, if files are smaller.
TASK_BYTES = 16 << 20
TEXT_FIELDS = ("$.type", "$.timestamp", "$.sessionId", "$.cwd", "$.entrypoint", "$.message.id", "$.message.model")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(parts, value): the path below root in parts, and the content, of each .jsonl file that lies in a folder of root."""
    # folders are listed by jobs of as many tasks as folders, up to this setting: its default of 10,000 is all overhead here
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tasks = spark.conf.get(key)
    spark.conf.set(key, str(min(int(tasks), 4 * spark.sparkContext.defaultParallelism)))
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    finally:
        spark.conf.set(key, tasks)
    # small files are planned as 4 MB each, which makes a task of every 32; here a task has 16 MB, if that gives work to all cores
    size = int(raw._jdf.queryExecution().analyzed().stats().sizeInBytes())
    most = max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rel = F.expr("substr(p, locate(b, p) + length(b))")
    return raw.select(F.col("content").cast("string").alias("value"), path.alias("p"), F.lit(base).alias("b")).coalesce(most).select(F.split(rel, "/").alias("parts"), "value").where(F.size("parts") >= 2)


def parsed_lines(spark: SparkSession, root: str) -> DataFrame:
    """A row for each line that isn't blank: file_no (a number for each file), parts, line, ok (a record), broken (meant as JSON,
    but no record), and the record r and its variant v; and one row with ok null for a file that isn't UTF-8."""
    text = F.when(F.is_valid_utf8("value"), F.split("value", "\n")).otherwise(F.array(F.lit(None).cast("string")))
    rows = files(spark, root).withColumn("file_no", F.monotonically_increasing_id()).select("file_no", "parts", F.posexplode(text).alias("line", "text")).withColumns({"line": F.when(F.col("text").isNull(), -1).otherwise(F.col("line")), "text": F.when(F.col("text").contains("\r"), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))})
    rows = rows.where(F.col("text").isNull() | F.col("text").startswith("{") | F.col("text").rlike(r"[^ \t\r\f\x0B]"))
    parsed = F.struct(F.from_json("text", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.expr("try_parse_json(text)").alias("v"))
    # as a generator's output: conditions on columns are pushed below them, with a parse for each time that they name r or v
    rows = rows.select("*", F.inline(F.array(parsed)))

    def kind(path: str):
        return F.expr(f"coalesce(schema_of_variant(try_variant_get(v, '{path}', 'variant')), 'VOID')")

    typed = F.lit(True)
    for path in TEXT_FIELDS:
        # looking into the variant costs more than both parsers, so that it's asked only where the record leaves the type open
        typed = typed & (~F.coalesce(F.col(f"r{path[1:]}").rlike(NO_TEXT), F.lit(False)) | kind(path).isin("STRING", "VOID"))
    side = F.expr("try_variant_get(v, '$.isSidechain', 'variant')")
    typed = typed & (F.col("r.isSidechain").isNotNull() | side.isNull() | (kind("$.isSidechain") == "BOOLEAN"))
    for c in COUNTS:
        typed = typed & (F.coalesce(F.col(f"r.message.usage.{c}"), F.lit(0)) >= 0)
    whole = F.rtrim(F.col("text")).endswith("}") & F.ltrim(F.col("text")).startswith("{")
    ok = F.col("r._corrupt").isNull() & F.col("v").isNotNull() & whole & typed
    rows = rows.withColumn("ok", F.when(F.col("line") >= 0, F.coalesce(ok, F.lit(False))))
    return rows.withColumn("broken", ~F.col("ok") & F.ltrim(F.col("text")).rlike(r"^[{\[]"))


def quality(lines: DataFrame) -> DataFrame:
    """(files, skipped_files, lines, skipped_lines)."""
    return lines.agg(F.countDistinct("file_no").alias("files"), F.count_if(F.col("ok").isNull()).alias("skipped_files"), F.count_if("ok").alias("lines"), F.count_if("broken").alias("skipped_lines"))


def activity(lines: DataFrame) -> DataFrame:
    """The activity relation (see sources.tables) of the records, with `year` as well."""
    x = lines.where("ok")
    content = "try_variant_get(v, '$.message.content', 'variant')"
    x = x.withColumns({"kind": F.expr(f"schema_of_variant({content})"), "said": F.expr("try_variant_get(v, '$.message.content', 'string')"), "items": F.expr("try_variant_get(v, '$.message.content', 'array<variant>')")})

    def of(path: str) -> str:
        return f"CASE WHEN schema_of_variant(try_variant_get(x, '{path}', 'variant')) = 'STRING' THEN try_variant_get(x, '{path}', 'string') END"

    tools = F.expr(f"transform(filter(items, x -> try_variant_get(x, '$.type', 'string') <=> 'tool_use' AND ({of('$.name')}) IS NOT NULL), x -> try_variant_get(x, '$.name', 'string'))")
    result = F.expr("size(items) > 0 AND forall(items, x -> try_variant_get(x, '$.type', 'string') <=> 'tool_result')")
    texts = F.expr(f"transform(items, x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') WHEN try_variant_get(x, '$.type', 'string') <=> 'tool_result' THEN NULL ELSE coalesce({of('$.text')}, {of('$.content')}) END)")
    blank = " \t\n\r\f\x0b"
    joined = F.array_join(F.filter(texts, lambda t: F.btrim(t, F.lit(blank)) != ""), "\n")
    text = F.when(F.col("kind") == "STRING", F.col("said")).otherwise(F.coalesce(joined, F.lit("")))
    ts, parts = F.col("r.timestamp"), F.col("parts")
    depth = F.size(parts)
    nested = (depth >= 4) & (F.get(parts, 2) == "subagents")
    usage = F.col("r.message.usage")
    return x.select(
        F.array_join(parts, "/").alias("file"),
        parts.alias("file_ord"),
        F.struct(parts, F.col("line")).alias("ord"),
        F.when(nested, "subagent").when(depth == 2, "session").otherwise("other").alias("role"),
        F.when(nested, F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit(".jsonl"))).alias("parent_file"),
        # a user or assistant record without a message counts for times only
        F.when(F.col("r.message").isNotNull(), F.col("r.type")).otherwise("none").alias("type"),
        usage.isNotNull().alias("has_usage"),
        F.col("r.message.id").alias("message_id"),
        F.coalesce(result, F.lit(False)).alias("is_tool_result"),
        F.coalesce(F.col("r.isSidechain"), F.lit(False)).alias("is_sidechain"),
        ts.alias("ts"),
        ft.parse_timestamp(ts).alias("moment"),
        ft.date_key(ts).alias("dt"),
        ft.local_hour(ts).alias("hour"),
        ft.written_year(ts).alias("year"),
        F.col("r.sessionId").alias("record_session_id"),
        F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("stem"),
        F.get(parts, 0).alias("project_hash"),
        F.array_contains(parts, "subagents").alias("is_subagent"),
        F.col("r.cwd").alias("cwd"),
        F.col("r.entrypoint").alias("entrypoint"),
        F.col("r.message.model").alias("model"),
        usage["input_tokens"].alias("input_tokens"),
        usage["output_tokens"].alias("output_tokens"),
        usage["cache_creation_input_tokens"].alias("cache_creation_tokens"),
        usage["cache_read_input_tokens"].alias("cache_read_tokens"),
        (F.col("r.costUSD") * UNIT).alias("cost_units"),
        F.coalesce(tools, F.array().cast("array<string>")).alias("tools"),
        F.btrim(text, F.lit(blank)).alias("text"),
    )


def read(spark: SparkSession, root: str) -> DataFrame:
    return activity(parsed_lines(spark, root))


def write_sample(spark: SparkSession, sf_dir: str) -> str:
    """All events as a tree of JSONL files, one for each user, every fifth user as a subagent of the user before; returns its root."""
    import json

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.fs as pafs

    from ledgerweave.sources.tables import of_events

    root = new_folder(spark, "logs")
    # the events are shuffled and sorted, as their lines are several times as long; a user is a file
    events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4 * spark.sparkContext.defaultParallelism, "user_id").sortWithinPartitions("user_id", "event_id")
    act = of_events(events).withColumn("user", F.regexp_extract("file", r"s(\d+)-", 1).cast("long"))
    main = F.when(F.col("is_subagent"), F.col("user") - 1).otherwise(F.col("user"))
    path = F.concat(F.lit("-work-proj--"), main % 7, F.lit("/user-"), main, F.when(F.col("is_subagent"), F.concat(F.lit("/subagents/user-"), F.col("user"))).otherwise(""), F.lit(".jsonl"))
    usage = F.struct("input_tokens", "output_tokens", F.col("cache_creation_tokens").alias("cache_creation_input_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"))
    content = F.when(F.col("type") == "assistant", F.array(F.struct(F.lit("tool_use").alias("type"), F.get("tools", 0).alias("name"), F.lit(None).cast("string").alias("text")))).when(F.col("is_tool_result"), F.array(F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text")))).otherwise(F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.col("text"))))
    message = F.struct(F.when(F.col("type") == "assistant", F.col("message_id")).alias("id"), "model", F.when(F.col("type") == "assistant", usage).alias("usage"), content.alias("content"))
    record = F.struct("type", F.col("is_sidechain").alias("isSidechain"), F.date_format(F.col("moment").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "cwd", (F.col("cost_units") / UNIT).alias("costUSD"), message.alias("message"))
    lines = act.select(path.alias("path"), F.concat(F.to_json(record), F.lit("\n")).alias("line"))

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        now, out, made = None, None, set()
        for batch in batches:
            runs, lines = pc.run_end_encode(batch.column(0)), batch.column(1)
            offsets, data = memoryview(lines.buffers()[1]).cast("i"), memoryview(lines.buffers()[2])
            begin = 0
            for p, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if p != now:
                    if out:
                        out.close()
                    folder = p.rpartition("/")[0]
                    if folder not in made:
                        fs.create_dir(f"{base}/{folder}")
                        made.add(folder)
                    now, out = p, fs.open_output_stream(f"{base}/{p}")
                    out.write((json.dumps({"type": "summary"}) + "\n{not json\n\n").encode())
                out.write(data[offsets[lines.offset + begin] : offsets[lines.offset + end]])
                begin = end
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], names=["n"])

    lines.mapInArrow(write, "n int").count()
    return root
