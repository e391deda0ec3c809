"""Readers of suites, predictions, labels and media. Each keeps the order of its rows where order is data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.order import settled
from . import schema as S


#: Bits of a row's place in its part of a file; a part of 128 MB can't have more rows.
PLACE_BITS = 27


def _row_ord() -> Column:
    """The order of a file's rows, however it is cut: where the row's part of the file begins, and its place there."""
    return F.shiftleft(F.col("_metadata.file_block_start"), PLACE_BITS) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """A JSON object a line; blank lines are skipped, a bad one fails the job. ``file`` and ``row_ord`` order the rows."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return rows.withColumn("row_ord", _row_ord()).withColumn("file", F.col("_metadata.file_path"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """How many lines that aren't blank each file under ``path`` has."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.groupBy("file").agg(F.count_if(F.trim("value") != "").alias("n"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def lossy_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Documents with bad bytes, one a file or (``lines``) one a line: such bytes become replacement characters, and the
    rest of the document is kept."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")) if lines else spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.from_json(text, schema).alias("doc")).select("path", "doc.*")


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """With a header, by whose names the columns are found; every value is a string, a missing column is null."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Without a header: id, start, label, split. Values are trimmed, short rows dropped, further fields ignored."""
    rows = spark.read.schema(f"{S.LABEL_CSV}, extra string").option("mode", "PERMISSIVE").csv(path)
    names = ("youtube_id", "start_seconds", "label", "split")
    return rows.where(F.col("split").isNotNull()).select(*(F.trim(c).alias(c) for c in names))


def suite(spark: SparkSession, root: str, file: str = "all.jsonl", schema: str = S.TASK_ROWS) -> DataFrame:
    """Rows of every ``task_*`` directory under ``root``, at any depth, with its name as task_dir and that above as tier;
    also of those that the writer of suites makes."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", file).json(root)
    where = F.col("_metadata.file_path")
    rows = rows.withColumn("task_dir", F.regexp_extract(where, r"/(?:task_dir=)?(task_[^/]+)/[^/]+$", 1)).withColumn("tier", F.regexp_extract(where, r"/(?:tier=)?([^/]+)/(?:task_dir=)?task_[^/]+/[^/]+$", 1))
    return rows.withColumn("row_ord", _row_ord()).withColumn("file", where).where("task_dir <> ''")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The predictions at ``path``, or none where there is no such path."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def task_names(rows: DataFrame) -> DataFrame:
    """Each directory's task name: the first that isn't empty, else the directory's own."""
    first = rows.groupBy("task_dir").agg(F.min_by(F.nullif("task_name", F.lit("")), F.when(F.col("task_name") != "", F.col("row_ord"))).alias("name"), F.count("*").alias("n"))
    return first.select("task_dir", F.coalesce("name", "task_dir").alias("task_name"), "n")


def the_task(rows: DataFrame, name: str) -> DataFrame:
    """The rows of the one directory with that task; it is an error if none or several have it."""
    found = task_names(rows).where((F.col("task_name") == name) | F.endswith("task_dir", F.lit(name)))
    one = found.agg(F.count("*").alias("n"), F.first("task_dir").alias("task_dir")).select("task_dir", F.assert_true(F.col("n") == 1, F.lit(f"not exactly one task {name}")).alias("_ok"))
    return rows.join(F.broadcast(one), "task_dir").where("_ok IS NULL").drop("_ok")


def flattened(documents: DataFrame, json: str, scenario: str) -> DataFrame:
    """(the other columns, record): the records of nested JSON documents, as variants with what they inherit beside them.

    Of a document's ``videos`` the clips are records, or the video itself where it has no list of clips; ``video_uid``,
    ``split`` and ``scenario`` are the record's own, or else its video's (uid or clip's uid), the video's or the document's
    split ("train" without any), and the column ``scenario``. A document without such records gives the objects of all its
    lists. Text that isn't JSON has none.
    """
    spark, keep = documents.sparkSession, [c for c in documents.columns if c != json]
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    each = lambda df, column: df.lateralJoin(spark.tvf.variant_explode(F.col(column).outer()))
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    opened = documents.select(*keep, F.try_parse_json(json).alias("_doc")).where(F.schema_of_variant("_doc").startswith("OBJECT"))
    opened = opened.withColumn("_id", F.monotonically_increasing_id())
    opened = settled(opened.select("*", get(F.col("_doc"), "$.videos", "variant").alias("_videos"), get(F.col("_doc"), "$.split").alias("_split")))
    has_list = lambda c: F.coalesce(F.schema_of_variant(c).startswith("ARRAY"), F.lit(False))
    videos = each(opened.where(has_list("_videos")), "_videos").where(is_object).select(*keep, "_id", F.col("pos").alias("_p"), F.col("value").alias("_video"), "_split")
    uid = F.coalesce(F.nullif(get(F.col("_video"), "$.video_uid"), F.lit("")), get(F.col("_video"), "$.clip_uid"), F.lit(""))
    videos = videos.select("*", get(F.col("_video"), "$.clips", "variant").alias("_clips"), uid.alias("_uid"), F.coalesce(get(F.col("_video"), "$.split"), "_split", F.lit("train")).alias("_vsplit"))
    clips = each(videos.where(has_list("_clips")), "_clips").where(is_object).select(*keep, "_id", F.array("_p", "pos").alias("_at"), F.col("value").alias("record"), "_uid", "_vsplit")
    whole = videos.where(~has_list("_clips")).select(*keep, "_id", F.array("_p").alias("_at"), F.col("_video").alias("record"), F.lit(None).cast("string").alias("_uid"), "_vsplit")
    nested = clips.unionByName(whole)
    rest = opened.join(nested.select("_id").distinct(), "_id", "left_anti")
    lists = each(rest, "_doc").where(has_list("value")).select(*keep, "_id", F.col("pos").alias("_p"), F.col("value").alias("_list"))
    other = each(lists, "_list").where(is_object).select(*keep, "_id", F.array("_p", "pos").alias("_at"), F.col("value").alias("record"), F.lit(None).cast("string").alias("_uid"), F.lit(None).cast("string").alias("_vsplit"))
    own = lambda name, inherited: F.coalesce(get(F.col("record"), f"$.{name}"), inherited).alias(name)
    inherits = F.when(F.col("_vsplit").isNotNull(), F.col(scenario))
    return nested.unionByName(other).select(*keep, "record", own("video_uid", F.col("_uid")), own("split", F.col("_vsplit")), own("scenario", inherits))


def source_pool(pairwise: DataFrame) -> DataFrame:
    """The first row of each source item."""
    w = Window.partitionBy("source_item_id").orderBy("row_ord")
    rows = pairwise.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return rows.select("source_item_id", F.coalesce(F.nullif("display_name", F.lit("")), "task_id").alias("display_name"), F.coalesce(F.nullif("positive_sample.audio_path", F.lit("")), F.lit("")).alias("audio_path"), F.coalesce(F.nullif("positive_sample.short_context_text", F.lit("")), "context_text").alias("context_text"))


def resolved(wanted: DataFrame, listing: DataFrame, key: str, suffix: str) -> DataFrame:
    """For each key the file whose name is it, starts with it, or holds it, in this order, then by path.

    ``listing`` has path and stem. Names and keys meet by equality: exact ones first; the keys left over meet the parts of
    stems that are as long as they are, of which the distinct lengths of those keys are made.
    """
    files = listing.where(F.endswith("path", F.lit(suffix))).select("path", "stem")
    names = wanted.select(key).where(F.length(key) > 0).distinct()
    exact = names.join(files, F.col(key) == F.col("stem")).select(key, "path", F.lit(0).alias("kind"))
    left = names.join(exact.select(key).distinct(), key, "left_anti")
    sizes = left.agg(F.collect_set(F.length(key)).alias("sizes"))  # one number for each length of a name
    cut = files.join(F.broadcast(sizes)).select("path", "stem", F.explode("sizes").alias("n")).where(F.length("stem") > F.col("n"))
    parts = cut.select("path", F.posexplode(F.expr("transform(sequence(1, length(stem) - n + 1), i -> substring(stem, i, n))")).alias("at", "part"))
    inside = left.join(parts, F.col(key) == F.col("part")).select(key, "path", F.when(F.col("at") == 0, 1).otherwise(2).alias("kind"))
    best = exact.unionByName(inside).groupBy(key).agg(F.min(F.struct("kind", "path")).alias("b"))
    return best.select(key, F.col("b.path").alias("path"), F.col("b.kind").alias("kind"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths, stems and sizes under ``root``, without their content; side files (``._``, ``.part``) are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.regexp_extract("path", "[^/]+$", 0)
    return rows.where(~F.startswith(name, F.lit("._")) & ~F.endswith(name, F.lit(".part"))).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))


# The keys under which entries of lists name a video and a clip, first ones first.
VIDEO_KEYS = ("youtube_id", "video_id", "yt_id", "video_name")
CLIP_KEYS = ("clip_name", "clip", "name", "video_name")


def list_entries(documents: DataFrame, json: str) -> DataFrame:
    """(the other columns, pos, youtube_id, clip_name): the entries of JSON lists in which texts and objects may be mixed.

    A text names both video and clip; an object names each by the first of its keys whose value is a text that isn't empty,
    a number other than 0, or true. Entries of other kinds, objects that lack a name and documents that aren't lists have none.
    """
    keep = [c for c in documents.columns if c != json]
    lists = documents.select(*keep, F.try_parse_json(json).alias("_doc")).where(F.schema_of_variant("_doc").startswith("ARRAY"))
    each = lists.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("_doc").outer())).select(*keep, "pos", "value")
    kind = F.schema_of_variant("value")

    def named(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*(_told("value", f"$.{k}") for k in keys))

    said = F.try_variant_get("value", "$", "string")
    both = lambda keys: F.when(kind == "STRING", said).when(kind.startswith("OBJECT"), named(keys))
    return each.select(*keep, "pos", both(VIDEO_KEYS).alias("youtube_id"), both(CLIP_KEYS).alias("clip_name")).where("youtube_id is not null and clip_name is not null")


def _told(value: str, path: str) -> Column:
    """A text that isn't empty, a number other than 0, or true, as text; null for all else."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    said = F.try_variant_get(value, path, "string")
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    return F.when(kind == "STRING", F.nullif(said, F.lit(""))).when(number & (F.try_variant_get(value, path, "double") != 0), said).when((kind == "BOOLEAN") & (said == "true"), F.lit("True"))


def membership_lists(documents: DataFrame, name: str, json: str) -> dict[str, DataFrame]:
    """Tables of clip names for ``split_membership`` from documents named all, sft and benchmark (column ``name``): entries of
    any shape in the first, plain texts or numbers in the others."""
    of = lambda which: documents.where(F.col(name) == which).select(json)
    plain = lambda df: df.where(F.schema_of_variant(F.try_parse_json(json)).startswith("ARRAY")).lateralJoin(documents.sparkSession.tvf.variant_explode(F.try_parse_json(json).outer())).select(F.try_variant_get("value", "$", "string").alias("clip_name")).where("clip_name is not null")
    return {"all": list_entries(of("all"), json).select("clip_name"), "sft": plain(of("sft")), "benchmark": plain(of("benchmark"))}


def split_membership(items: DataFrame, key: str, members: dict[str, DataFrame]) -> DataFrame:
    """benchmark before sft before all; unassigned otherwise. ``members`` has one-column tables of keys."""
    out, label = items, F.lit("unassigned")
    for name in ("all", "sft", "benchmark"):
        if name in members:
            flag = members[name].toDF(key).distinct().withColumn(f"_{name}", F.lit(True))
            out = out.join(flag, key, "left")
            label = F.when(F.col(f"_{name}"), name).otherwise(label)
    return out.withColumn("split", label).select(*items.columns, "split")


def base64_audio(files: DataFrame) -> DataFrame:
    """(path, data, format) of a binaryFile table."""
    ending = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return files.select("path", F.base64("content").alias("data"), F.when(ending == "mpga", "mp3").otherwise(ending).alias("format"))

