"""Readers (S1-S6, S8, S9).

Article snapshots are JSON *arrays* (one per collection run). A JSON array
file is not splittable, so each file is parsed by one task; for large
collections convert once to Parquet (:func:`tidings.sources.writers.write_table`)
and read that. Label maps are JSON *objects* ``{article_id: label}``; the
same applies, and :func:`read_label_lines` reads the splittable JSON-lines
form ``{"article_id": ..., "label": ...}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.operators.profile import with_row_index
from tidings.session import stage

FIELDS = T.StructType([
    T.StructField("headline", T.StringType()),
    T.StructField("standfirst", T.StringType()),
    T.StructField("bodyText", T.StringType()),
])

ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("webTitle", T.StringType()),
    T.StructField("webUrl", T.StringType()),
    T.StructField("webPublicationDate", T.StringType()),
    T.StructField("fields", FIELDS),
])

SEARCH_PAGE = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("response", T.StructType([
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("pages", T.IntegerType()),
        T.StructField("currentPage", T.IntegerType()),
        T.StructField("results", T.ArrayType(ARTICLE)),
    ])),
])

PREDICTION_RUN = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("zero_shot", T.StructType([
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("predictions", T.MapType(T.StringType(), T.IntegerType()))])),
    T.StructField("few_shot", T.StructType([
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("predictions", T.MapType(T.StringType(), T.IntegerType()))])),
    T.StructField("ground_truth", T.MapType(T.StringType(), T.IntegerType())),
])


def flatten_articles(df: DataFrame) -> DataFrame:
    """Nested article rows -> flat columns (nested column pruning keeps only
    the ``fields`` members that are used downstream)."""
    keep = [c for c in df.columns if c != "fields"]
    return df.select(*keep, F.col("fields.headline").alias("headline"),
                     F.col("fields.standfirst").alias("standfirst"),
                     F.col("fields.bodyText").alias("bodyText"))


def read_articles(spark: SparkSession, path: str, flat: bool = True, multiline: bool = True) -> DataFrame:
    """JSON array file(s) of nested article records, explicit schema.
    ``multiline=False`` reads the splittable JSON-lines form Spark writes."""
    df = spark.read.schema(ARTICLE).option("multiLine", multiline).json(path)
    return flatten_articles(df) if flat else df


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("src_file", F.col("_metadata.file_path")) \
             .withColumn("src_mtime", F.col("_metadata.file_modification_time"))


def read_article_snapshots(spark: SparkSession, paths, flat: bool = True, multiline: bool = True) -> DataFrame:
    """Many snapshot files -> one row per id; rows without an id are
    skipped; the row from the latest file (modification time, then path) wins, of
    several in one file the last one read.

    The rows are staged once with their position, which is taken as they are read:
    a position computed anew above a join or shuffle need not be the same twice.
    The winner is picked on ids and one number per row: the file's rank, by its
    position in the table of files (:func:`tidings.operators.profile.with_row_index`), and the position. Bodies come from a semi join with
    the winners' positions and are never sorted or aggregated."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = _with_file(spark.read.schema(ARTICLE).option("multiLine", multiline).json(paths)).where(F.col("id").isNotNull())
    rows = stage(df.withColumn("_position", F.monotonically_increasing_id()), "snapshot-rows")
    ranks = with_row_index(rows.select("src_file", "src_mtime").distinct(), ["src_mtime", "src_file"], "_rank")
    ranks = ranks.select(F.col("src_file").alias("_file"), "_rank")
    span = F.lit(str(1 << 63)).cast("decimal(19,0)")
    order = (F.col("_rank").cast("decimal(18,0)") * span + F.col("_position")).cast("decimal(38,0)")
    ranked = rows.select("id", "src_file", "_position").join(ranks, F.col("src_file") == F.col("_file"))
    winners = ranked.groupBy("id").agg(F.max(order).alias("_last")).select((F.col("_last") % span).cast("long").alias("_position"))
    out = rows.join(winners, "_position", "left_semi").select(*ARTICLE.fieldNames())
    return flatten_articles(out) if flat else out


def latest_snapshot(spark: SparkSession, paths, flat: bool = True, multiline: bool = True,
                    unit: str = "file") -> DataFrame:
    """S3: only the most recently modified snapshot (ties: last path).

    ``unit="file"``: a snapshot is one file (the reference's JSON array per
    run). ``unit="dir"``: a snapshot is a folder of part files, as Spark
    writes it; the folder holding the newest file wins. The choice is made on
    the list of files, without opening one; only the chosen snapshot is parsed."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "modificationTime")
    listed = listed.where(~F.col("path").rlike("/[._][^/]*$"))
    if unit == "dir":
        listed = listed.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    newest = listed.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]
    chosen = spark.read.schema(ARTICLE).option("multiLine", multiline)
    out = chosen.json(newest["path"]) if newest is not None else spark.createDataFrame([], ARTICLE)
    return flatten_articles(out) if flat else out


def read_label_map(spark: SparkSession, path, rater: str | None = None, as_int: bool = False,
                   precedence: str = "name") -> DataFrame:
    """JSON object files ``{article_id: number}`` -> long rows
    ``(article_id, rater, label, src_file, pos)``. A repeated key keeps its last
    occurrence (Q18). An unreadable file yields no rows and is reported by
    :func:`label_map_errors`. ``as_int`` truncates (P24). ``src_file`` is
    the file name (``precedence="name"``, the reference's sort key, O4) or
    the full path (``"path"``, for partitioned folders of batch files)."""
    meta = "_metadata.file_path" if precedence == "path" else "_metadata.file_name"
    raw = spark.read.text(path, wholetext=True).select("value", F.col(meta).alias("src_file"))
    m = raw.select("src_file", F.from_json("value", "map<string,double>").alias("m"))
    rows = m.select("src_file", F.posexplode(F.map_entries("m")).alias("pos", "e")) \
            .select("src_file", "pos", F.col("e.key").alias("article_id"), F.col("e.value").alias("label"))
    rows = rows.groupBy("src_file", "article_id").agg(F.max_by("label", "pos").alias("label"),
                                                      F.max("pos").alias("pos"))
    lab = F.col("label").cast("int").cast("double") if as_int else F.col("label")
    return rows.select("article_id", F.lit(rater).cast("string").alias("rater"), lab.alias("label"),
                       "src_file", "pos")


def label_map_errors(spark: SparkSession, path) -> DataFrame:
    """U4 helper: files whose content is not a JSON object of numbers."""
    raw = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("src_file"))
    return raw.where(F.from_json("value", "map<string,double>").isNull()).select("src_file")


def read_label_lines(spark: SparkSession, path, rater: str | None = None) -> DataFrame:
    """Splittable JSON-lines label files ``{"article_id", "label"}``."""
    df = spark.read.schema("article_id string, label double").json(path)
    return df.select("article_id", F.lit(rater).cast("string").alias("rater"), "label",
                     F.col("_metadata.file_name").alias("src_file"), F.lit(0).alias("pos"))


def read_prediction_run(spark: SparkSession, path, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Run records -> ``(predictions(run, mode, article_id, pred),
    truth(run, article_id, label))``. ``multiline=False``: one record a line."""
    df = spark.read.schema(PREDICTION_RUN).option("multiLine", multiline).json(path) \
        .withColumn("run", F.concat_ws("@", "model", "timestamp"))
    modes = [F.struct(F.lit(m).alias("mode"), F.col(f"{m}.predictions").alias("p")) for m in ("zero_shot", "few_shot")]
    preds = (df.select("run", F.explode(F.array(*modes)).alias("x"))
               .select("run", F.col("x.mode").alias("mode"), F.explode("x.p").alias("article_id", "pred")))
    truth = df.select("run", F.explode("ground_truth").alias("article_id", "label"))
    return preds, truth


def read_prices(spark: SparkSession, path, symbol: str | None = None,
                ts_format: str = "yyyy-MM-dd HH:mm:ssXXX") -> DataFrame:
    """Price CSV whose first column is an offset timestamp and which has a
    ``Close`` column -> ``(symbol, ts, close)``; ``ts`` is an instant, its
    calendar date is taken in the session time zone (UTC)."""
    df = spark.read.option("header", True).csv(path)
    first = df.columns[0]
    sym = F.col("Symbol") if "Symbol" in df.columns else F.lit(symbol)
    return df.select(sym.cast("string").alias("symbol"),
                     F.to_timestamp(F.col(first), ts_format).alias("ts"),
                     F.col("Close").cast("double").alias("close"))


def assemble_pages(pages: DataFrame, max_articles: int | None = None) -> DataFrame:
    """Paged search responses in page order, from page 1. Collection stops
    before the first page that failed, is not ``ok``, has no results or never landed,
    and after the first page whose own response says that it is the last
    (``page >= response.pages``, where a response without the number counts as one page);
    ``max_articles`` caps it (a top-k).

    ``pages``: ``(page, response struct)`` as read with :data:`SEARCH_PAGE`.
    Output: flat article rows with ``page``, ``pos``. A page that landed twice counts once
    for the stop rules, and as the last one only if all its responses say so.
    """
    bad = F.col("response").isNull() | ~F.col("response.status").eqNullSafe("ok") | \
        (F.coalesce(F.size("response.results"), F.lit(0)) <= 0)
    last = F.col("page") >= F.coalesce(F.col("response.pages"), F.lit(1))
    narrow = pages.where("page >= 1").select("page", bad.alias("bad"), last.alias("last"))
    seen = narrow.groupBy("page").agg(F.max("bad").alias("bad"), F.min("last").alias("last"))
    after = seen.select((F.col("page") + 1).alias("page")).join(seen, "page", "left_anti")  # numbers that follow a landed page but didn't land
    # bounded: one row of three numbers
    stop = seen.agg(F.min("page").alias("first"), F.min(F.when(F.col("bad"), F.col("page"))).alias("bad"),
                    F.min(F.when(~F.col("bad") & F.col("last"), F.col("page") + 1)).alias("after_last")).first()
    missing = after.agg(F.min("page")).first()[0]
    ends = [x for x in (stop["bad"], missing, stop["after_last"]) if x is not None]
    if stop["first"] != 1:
        ends = [1]  # nothing landed, or the first page is missing
    ok = pages.where((F.col("page") >= 1) & (F.col("page") < min(ends)))
    rows = ok.select("page", F.posexplode("response.results").alias("pos", "a")).select("page", "pos", "a.*")
    rows = flatten_articles(rows)
    if max_articles is not None:
        rows = rows.orderBy("page", "pos").limit(max_articles)
    return rows


def read_search_pages(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Landed search responses ``{page, response{status, ..., results}}``."""
    return spark.read.schema(SEARCH_PAGE).option("multiLine", multiline).json(path)


def collection_window(articles: DataFrame, end, days: int = 730,
                      date_col: str = "webPublicationDate") -> DataFrame:
    """Articles published in the ``days`` before ``end`` (inclusive)."""
    day = F.try_to_date(F.substring(F.col(date_col), 1, 10), "yyyy-MM-dd")
    e = F.lit(end).cast("date") if not isinstance(end, Column) else end
    return articles.where((day >= F.date_sub(e, days)) & (day <= e))


def read_dated_labels(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Labels written by :func:`tidings.sources.writers.write_dated_labels`,
    restricted to ``[start, end]`` (inclusive days). The month predicate is
    a partition filter (whole folders skipped); the day predicate is pushed
    to the Parquet reader."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("month") >= F.date_format(F.lit(start).cast("date"), "yyyy-MM"))
                      & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col("month") <= F.date_format(F.lit(end).cast("date"), "yyyy-MM"))
                      & (F.col("date") <= F.lit(end).cast("date")))
    return df


def read_run_long(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S5 for runs written by :func:`tidings.sources.writers.write_run_long`:
    ``(summary, predictions(mode, article_id, pred), truth(article_id, label))``."""
    return (spark.read.json(f"{path}/summary"), spark.read.parquet(f"{path}/predictions"),
            spark.read.parquet(f"{path}/truth"))


_ENTRY_LINE = r'^\s*(".*")\s*:\s*([-+0-9.eE]+|null)\s*,?\s*$'


def read_label_map_lines(spark: SparkSession, path, rater: str | None = None) -> DataFrame:
    """S4 for large, pretty-printed label maps (one ``"id": label`` entry per
    line, the layout ``json.dump(..., indent=2)`` writes): the files are read
    line by line, so a big file is split across tasks instead of being parsed
    whole by one. Each entry line is parsed as a one-entry JSON object (string
    escapes handled by ``from_json``); a repeated key keeps its last
    occurrence (positions increase with the file offset).

    As with :func:`read_label_map`, a file that holds anything else (another layout, a value
    that is no number) yields no rows; :func:`label_map_line_errors` names it."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("src_file"),
        F.monotonically_increasing_id().alias("pos"))
    entries = raw.where(F.col("value").rlike(_ENTRY_LINE)).select(
        "src_file", "pos",
        F.from_json(F.concat(F.lit("{"), F.regexp_extract("value", _ENTRY_LINE, 1), F.lit(":"),
                             F.regexp_extract("value", _ENTRY_LINE, 2), F.lit("}")),
                    "map<string,double>").alias("m"))
    entries = entries.join(label_map_line_errors(spark, path), "src_file", "left_anti")
    rows = entries.select("src_file", "pos", F.explode("m").alias("article_id", "label"))
    rows = rows.groupBy("src_file", "article_id").agg(F.max_by("label", "pos").alias("label"),
                                                      F.max("pos").alias("pos"))
    return rows.select("article_id", F.lit(rater).cast("string").alias("rater"), "label", "src_file", "pos")


def label_map_line_errors(spark: SparkSession, path) -> DataFrame:
    """Files that :func:`read_label_map_lines` cannot read: ``src_file`` and the
    number of lines that are neither an entry, a brace nor blank."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("src_file"))
    fine = F.col("value").rlike(_ENTRY_LINE) | F.col("value").rlike(r"^\s*[{}]?\s*$") | F.col("value").rlike(r"^\s*\{\s*\}\s*$")
    return raw.where(~fine).groupBy("src_file").agg(F.count("*").alias("bad_lines"))
