"""Quality metrics, run statistics, rankings and the joining of streams and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.sources.frames import in_stream
from reelspark.sources.shared import shared_folder


def pair_frames(source: DataFrame, encoded: DataFrame, column: str = "plane") -> DataFrame:
    """Frames of both sides by place in their stream: ``stream_id, n, a, b``. Frames without a partner are left out."""
    side = lambda df, name: df.select("stream_id", F.row_number().over(in_stream()).alias("n"), F.col(column).alias(name))
    return side(source, "a").join(side(encoded, "b"), ["stream_id", "n"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def plane_difference(a: Column, b: Column, squared: bool = False) -> Column:
    """The sum of absolute or squared differences of two planes."""
    return _total(F.zip_with(a, b, (lambda x, y: (x - y) * (x - y)) if squared else (lambda x, y: F.abs(x - y))))


def block_ssim(a: Column, b: Column, peak: int = 255) -> Column:
    """Structural similarity of two 8x8 blocks from integer sums."""
    c1, c2 = 0.01**2 * peak**2 * 64, 0.03**2 * peak**2 * 64 * 63
    s1, s2 = _total(a), _total(b)
    squares = _total(F.transform(a, lambda x: x * x)) + _total(F.transform(b, lambda x: x * x))
    cross = _total(F.zip_with(a, b, lambda x, y: x * y))
    spread, joint = 64 * squares - s1 * s1 - s2 * s2, 64 * cross - s1 * s2
    return (2 * s1 * s2 + c1) * (2 * joint + c2) / ((s1 * s1 + s2 * s2 + c1) * (spread + c2))


def quality_report(pairs: DataFrame, samples: int = 64, peak: int = 255) -> DataFrame:
    """Per stream: frames, mean SSIM and its dB, and the PSNR of the mean squared error (not the mean of PSNRs).

    dB are null where there is no error.
    """
    scored = pairs.select("stream_id", block_ssim(F.col("a"), F.col("b"), peak).alias("ssim"), (plane_difference(F.col("a"), F.col("b"), True) / samples).alias("mse"))
    sums = scored.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum("ssim").alias("s"), F.sum("mse").alias("e"))
    n = F.col("frames")
    return sums.select("stream_id", "frames", (F.col("s") / n).alias("ssim"), F.when(n - F.col("s") > 1e-12, 10 * F.log10(n / (n - F.col("s")))).alias("ssim_db"), F.when(F.col("e") > 0, 10 * F.log10(peak**2 / (F.col("e") / n))).alias("psnr"))


def run_statistics(frames: DataFrame, by: str = "frame_type") -> DataFrame:
    """Frames, summed duration and mean luma of each frame type."""
    return frames.groupBy(by).agg(F.count("*").alias("frames"), F.sum("duration").alias("duration"), F.avg("luma").alias("mean_luma"))


def encode_statistics(encoded: DataFrame, fps: float, dropped: int = 0) -> DataFrame:
    """Per class of coded frame (I, P, B): frames, IDR frames among them, bytes and mean quantiser; a row ``all`` with ``kbps`` at ``fps``.

    ``encoded``: ``frame_type`` (IDR, I, P or B), ``bytes``, ``qp``. IDR frames count as
    I. Frames of another or no type are in the sum only. Classes without a frame give
    no row; an empty table gives none.
    """
    kind = F.when(F.col("frame_type").isin("IDR", "I"), "I").when(F.col("frame_type").isin("P", "B"), F.col("frame_type"))
    sums = [F.count("*").alias("frames"), F.count(F.when(F.col("frame_type") == "IDR", 1)).alias("idr"), F.sum("bytes").alias("bytes"), F.sum("qp").alias("qp"), F.count("qp").alias("with_qp")]
    classes = encoded.groupBy(F.coalesce(kind, F.lit("other")).alias("frame_type")).agg(*sums)
    # Four rows at most, so the sum over them costs nothing and the input is read once.
    rows = classes.select(F.explode(F.array("frame_type", F.lit("all"))).alias("frame_type"), "frames", "idr", "bytes", "qp", "with_qp").where("frame_type <> 'other'")
    total = rows.groupBy("frame_type").agg(*(F.sum(c).alias(c) for c in ("frames", "idr", "bytes", "qp", "with_qp")))
    kbps = F.when(F.col("frame_type") == "all", F.col("bytes") * 8 * fps / (1000 * (F.col("frames") + dropped)))
    return total.select("frame_type", "frames", "idr", "bytes", F.when(F.col("with_qp") > 0, F.col("qp") / F.col("with_qp")).alias("mean_qp"), kbps.alias("kbps"))


def bitrate(encoded: DataFrame, fps: float, dropped: int = 0) -> DataFrame:
    """One row: frames, bytes, and ``kbps`` at ``fps`` with the dropped frames counted."""
    total = encoded.agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"))
    return total.select("frames", "bytes", (F.col("bytes") * 8 * fps / (1000 * (F.col("frames") + dropped))).alias("kbps"))


#: Parts of a group's values that percentiles are looked for in.
PARTS = 256


def _percentiles(counts: DataFrame, key: str, value: str, percentiles: tuple[float, ...]) -> DataFrame:
    """``key, at``: a map from rank to value with the ranks that percentiles need, exact, from the counts of distinct values.

    Approximate quantiles cut each group's values into parts; counts of parts tell in which
    of them a rank lies, and only these are put in order, each by itself.
    """
    cuts = counts.groupBy(key).agg(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 4 * PARTS).alias("cuts"), F.sum("n").alias("total"))
    placed = counts.join(cuts, key).select(key, value, "n", "total", F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("part"))
    folder = shared_folder(counts.sparkSession, "percentiles")
    placed.write.parquet(f"{folder}/placed")  # so that all steps see the same parts
    placed = counts.sparkSession.read.schema(placed.schema).parquet(f"{folder}/placed")
    sums = placed.groupBy(key, "part").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    before = F.sum("m").over(Window.partitionBy(key).orderBy("part")) - F.col("m")
    ranks = F.array_distinct(F.array(*[f(p * (F.col("total") - 1)).cast("long") for p in percentiles for f in (F.floor, F.ceil)]))
    wanted = sums.withColumn("before", before).withColumn("rank", F.explode(ranks)).where("rank >= before AND rank < before + m").select(key, "part", "before", "rank")
    inside = placed.join(wanted.select(key, "part").distinct(), [key, "part"], "left_semi")
    until = F.sum("n").over(Window.partitionBy(key, "part").orderBy(value))
    found = inside.withColumn("until", until).join(wanted, [key, "part"]).where("rank >= before + until - n AND rank < before + until")
    return found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("at"))


def score_distribution(scores: DataFrame, by: str, value: str, percentiles: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95)) -> DataFrame:
    """Mean, population deviation, least, greatest and interpolated percentiles of a score per group.

    Null scores don't count; a group of nulls has nulls. The group null is one of its own.
    """
    rows = scores.select(F.struct(F.col(by)).alias("_key"), F.col(value).cast("double").alias("_v"))
    sums = rows.groupBy("_key").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("deviation"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), F.count("_v").alias("_n"))
    counts = rows.where("_v IS NOT NULL").groupBy("_key", "_v").agg(F.count("*").alias("n"))
    out = sums.join(_percentiles(counts, "_key", "_v", percentiles), "_key", "left")

    def percentile(p: float) -> Column:
        place = p * (F.col("_n") - 1)
        low, high = (F.try_element_at("at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return out.select(F.col("_key").getField(by).alias(by), "mean", "deviation", "least", "greatest", *[percentile(p).alias(f"p{round(100 * p):02d}") for p in percentiles])


def rank_devices(devices: DataFrame, weights: dict[str, float], top: int = 1) -> DataFrame:
    """The ``top`` rows of ``id`` and weighted columns by score, the least id first on ties."""
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return devices.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def interleave(*streams: DataFrame) -> DataFrame:
    """Packets of several streams in the order of a container: by dts, then by stream; range-sorted over all tasks."""
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    return out.orderBy("dts", "stream_id", "frame_id")


def join_chunks(frames: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Chunks that each start at 0 put behind one another: pts and ids move by the ends of the chunks before."""
    sizes = frames.groupBy("stream_id", chunk).agg(F.max(F.col("pts") + F.col("duration")).alias("_end"), (F.max("frame_id") + 1).alias("_ids"))
    w = Window.partitionBy("stream_id").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("stream_id", chunk, F.coalesce(F.sum("_end").over(w), F.lit(0)).alias("_at"), F.coalesce(F.sum("_ids").over(w), F.lit(0)).alias("_first"))
    return frames.join(moved, ["stream_id", chunk]).withColumns({"pts": F.col("pts") + F.col("_at"), "frame_id": F.col("frame_id") + F.col("_first")}).drop("_at", "_first")


def split_chunks(frames: DataFrame, key: str, every: int) -> DataFrame:
    """Adds ``chunk``: a new one begins at every ``every``-th key frame, and ends before the next one's pts."""
    keys = F.sum(F.when(F.col(key), 1).otherwise(0)).over(in_stream().rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("chunk", F.floor(F.greatest(keys - 1, F.lit(0)) / every).cast("long"))
