"""Text files that accompany a stream: timecodes, chapters, key frame lists, film-grain tables, packet dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: the first line of a film-grain table.
GRAIN_HEADER = "filmgrn1"
# Fixed value: the first line of version-2 timecodes.
TIMECODE_HEADER = "# timecode format v2"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines of small side files with their file and place; a file is one value, so its lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def _frames_of(texts: DataFrame, key: str, timebase: int) -> DataFrame:
    """The frames of timecodes in ``value``, in the order of their lines, without a shuffle."""
    lines = F.filter(F.split("value", "\r\n?|\n"), lambda x: F.trim(x).rlike("^[0-9]"))
    pts = F.transform(lines, lambda x: F.round(F.trim(x).cast("decimal(28,9)") * timebase / 1000).cast("long"))
    spans = F.zip_with("pts", F.slice("pts", 2, 1 << 30), lambda a, b: F.struct(a.alias("pts"), (b - a).alias("duration")))
    rows = texts.select(key, pts.alias("pts")).select(key, F.posexplode(spans).alias("frame_id", "x"))
    return rows.select(key, F.col("frame_id").cast("long").alias("frame_id"), "x.pts", "x.duration")


def read_timecodes(spark: SparkSession, path: str, timebase: int = 1_000_000) -> DataFrame:
    """Version-2 timecodes (milliseconds per line, ``#`` comments) as ``file, frame_id, pts, duration`` in ticks of 1/``timebase`` s.

    Blank lines and comments don't count as frames; the last frame has no duration.
    """
    return _frames_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "file", timebase)


def _milliseconds(timebase: int) -> Column:
    return F.format_string("%.6f", F.col("pts") * 1000 / timebase)


def write_timecodes(frames: DataFrame, path: str, timebase: int = 1_000_000) -> None:
    """A folder per stream with its timecodes in order of ``pts``, one file each; for thousands of streams see ``write_timecode_sets``."""
    rows = frames.repartition("stream_id").sortWithinPartitions("stream_id", "pts")
    rows.select("stream_id", _milliseconds(timebase).alias("value")).write.mode("overwrite").partitionBy("stream_id").text(path)


def write_timecode_sets(frames: DataFrame, path: str, timebase: int = 1_000_000) -> None:
    """The timecodes of all streams, in order of ``pts``, as text files that hold many streams each.

    A stream is a run of lines: the header, ``# stream_id=`` and its times. What stands
    from one header to the next is a timecode file of its own.
    """
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("pts"))
    rows = frames.select("stream_id", "pts", place.alias("place")).sortWithinPartitions("stream_id", "place")
    head = F.concat(F.lit(f"{TIMECODE_HEADER}\n# stream_id="), F.coalesce(F.col("stream_id").cast("string"), F.lit("")), F.lit("\n"))
    lines = F.concat(F.when(F.col("place") == 1, head).otherwise(""), _milliseconds(timebase))
    rows.select(lines.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def read_timecode_sets(spark: SparkSession, path: str, timebase: int = 1_000_000) -> DataFrame:
    """The files of ``write_timecode_sets`` as ``stream_id, frame_id, pts, duration``; large ones are read by several tasks, cut between streams."""
    texts = spark.read.text(path, lineSep=TIMECODE_HEADER).where(F.col("value").rlike(r"^\s*# stream_id="))
    return _frames_of(texts.select(F.regexp_extract("value", r"^\s*# stream_id=(-?\d*)", 1).try_cast("long").alias("stream_id"), "value"), "stream_id", timebase)


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of the nero text form (``CHAPTER01=00:00:10.500``, ``CHAPTER01NAME=...``) as ``file, id, start_ms, name``.

    Other lines are ignored; a chapter without a name has null there.
    """
    lines = _numbered(spark, path)
    at = r"(?i)^\s*CHAPTER(\d+)\s*=\s*(\d+):(\d+):(\d+)(?:[.,:](\d{1,3}))?\s*$"
    part = lambda k: F.regexp_extract("line", at, k)
    starts = lines.where(F.col("line").rlike(at)).select("file", part(1).cast("int").alias("id"), ((part(2).cast("long") * 3600 + part(3).cast("long") * 60 + part(4).cast("long")) * 1000 + F.coalesce(F.rpad(part(5), 3, "0").try_cast("long"), F.lit(0))).alias("start_ms"))
    name = r"(?i)^\s*CHAPTER(\d+)NAME\s*=(.*)$"
    names = lines.where(F.col("line").rlike(name)).select("file", F.regexp_extract("line", name, 1).cast("int").alias("id"), F.trim(F.regexp_extract("line", name, 2)).alias("name"))
    return starts.join(names.groupBy("file", "id").agg(F.min("name").alias("name")), ["file", "id"], "left")


def read_matroska_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of the Matroska XML form as ``id, start_ms, name``; ``id`` numbers a file's chapters in the order of their starts."""
    rows = spark.read.option("rowTag", "ChapterAtom").schema("ChapterTimeStart string, ChapterDisplay struct<ChapterString:string>").xml(path)
    t = F.split("ChapterTimeStart", "[:.]")
    ms = (F.get(t, 0).cast("long") * 3600 + F.get(t, 1).cast("long") * 60 + F.get(t, 2).cast("long")) * 1000 + F.coalesce(F.rpad(F.substring(F.get(t, 3), 1, 3), 3, "0").try_cast("long"), F.lit(0))
    rows = rows.select(F.input_file_name().alias("file"), ms.alias("start_ms"), F.col("ChapterDisplay.ChapterString").alias("name"))
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("start_ms", "name")).alias("id"), "start_ms", "name")


def read_apple_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of the Apple XML form (``<TextSample sampleTime="00:00:10.500">name</TextSample>``) as ``file, id, start_ms, name``, numbered in the order of the file.

    Samples without a time or with one that can't be read are left out; one without text has a null name.
    """
    rows = spark.read.option("rowTag", "TextSample").schema("_sampleTime string, _VALUE string").xml(path)
    at = r"^(\d+):(\d+)[:.](\d+)[:.](\d{1,3})"
    part = lambda k: F.regexp_extract("_sampleTime", at, k).cast("long")
    ms = F.when(F.col("_sampleTime").rlike(at), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))
    rows = rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), ms.alias("start_ms"), F.nullif(F.trim("_VALUE"), F.lit("")).alias("name")).where("start_ms IS NOT NULL")
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("place")).alias("id"), "start_ms", "name")


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """One frame id per line as ``frame_id``; lines that hold no number are ignored."""
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("frame_id")).where("frame_id IS NOT NULL").distinct()


def read_grain_table(spark: SparkSession, path: str) -> DataFrame:
    """Interval rows of a film-grain table as ``file, start, end, apply, seed, update, params`` (the lines below, as one string).

    Files without the header give no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value")).where(F.col("value").startswith(GRAIN_HEADER))
    entries = files.select("file", F.explode(F.slice(F.split("value", r"(?m)^E\s+"), 2, 1 << 30)).alias("entry"))
    head = F.split(F.substring_index("entry", "\n", 1), r"\s+")
    number = lambda k: F.get(head, k).try_cast("long")
    body = F.trim(F.regexp_replace(F.regexp_replace("entry", r"^[^\n]*\n?", ""), r"\s+", " "))
    return entries.select("file", number(0).alias("start"), number(1).alias("end"), number(2).alias("apply"), number(3).alias("seed"), number(4).alias("update"), body.alias("params"))


def write_grain_table(entries: DataFrame, path: str) -> None:
    """A film-grain table as one text file from ``start, end, apply, seed, update, params``, in order of start; ``params`` stand on a line of their own."""
    head = F.concat_ws(" ", F.lit("E"), *[F.col(c).cast("string") for c in ("start", "end", "apply", "seed", "update")])
    lines = entries.select(F.struct("start", "end", F.concat(head, F.lit("\n\t"), F.coalesce("params", F.lit(""))).alias("text")).alias("x"))
    table = lines.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.concat_ws("\n", F.lit(GRAIN_HEADER), F.transform("x", lambda x: x["text"])).alias("value"))
    table.coalesce(1).write.mode("overwrite").text(path)


def write_packet_index(packets: DataFrame, path: str) -> None:
    """The packet index as CSV with a header."""
    packets.select("poc", "pts", "dts", "duration", "duration2", "flags", "repeat_pict", "pic_struct").write.mode("overwrite").option("header", True).csv(path)
