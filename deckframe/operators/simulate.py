"""Master snapping, splits, samples and quotas, over elements and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1920.0, 1080.0
#: The master's title slot, body slots (x, width, height; first y and step), grid and margin.
TITLE_SLOT = (96.0, 72.0, 1728.0, 72.0)
BODY_X, BODY_W, BODY_H, BODY_Y0, BODY_DY = 144.0, 1512.0, 72.0, 180.0, 92.0
GRID, MARGIN = 24.0, 96.0


def snap_to_master(elements: DataFrame) -> DataFrame:
    """Titles in the title slot, texts in body slots by rank of (y, pos), others on a grid within the page."""
    body = F.col("etype") == "text"
    slot = F.row_number().over(Window.partitionBy("slide_id", "etype").orderBy("y", "pos")) - 1
    grid = lambda c: F.bround(F.col(c) / GRID) * GRID
    clamp = lambda c, size, limit: F.greatest(F.lit(MARGIN), F.least(grid(c), limit - MARGIN - F.col(size)))
    title = F.col("etype") == "title"
    place = lambda t, b, other: F.when(title, t).when(body, b).otherwise(other)
    x = place(F.lit(TITLE_SLOT[0]), F.lit(BODY_X), clamp("x", "w", WIDTH))
    y = place(F.lit(TITLE_SLOT[1]), BODY_Y0 + BODY_DY * F.col("slot"), clamp("y", "h", HEIGHT))
    w, h = place(F.lit(TITLE_SLOT[2]), F.lit(BODY_W), F.col("w")), place(F.lit(TITLE_SLOT[3]), F.lit(BODY_H), F.col("h"))
    return elements.withColumn("slot", slot).select("slide_id", "pos", "etype", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def splits(samples: DataFrame, held_type: str = "G6", held_severity: float = 16.0) -> DataFrame:
    """ood_defect, ood_severity, or train, dev and test by (ord + 100 * severity) modulo 10 at 7, 2 and 1."""
    bucket = F.pmod(F.col("ord") + (F.col("severity") * 100).cast("long"), F.lit(10))
    split = F.when(F.col("type") == held_type, "ood_defect").when(F.col("severity") == held_severity, "ood_severity").when(bucket < 7, "train").when(bucket < 9, "dev").otherwise("test")
    return samples.withColumn("split", split)


def capped(samples: DataFrame, keys: list[str], cap: int, order: str = "ord") -> DataFrame:
    """The first ``cap`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def stratified_sample(samples: DataFrame, keys: list[str], n: int, seed: int = 7, id_col: str = "sample_id") -> DataFrame:
    """``n`` rows of each key in the order of a seeded hash; the same seed gives the same rows."""
    h = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(id_col).cast("string")))
    w = Window.partitionBy(*keys).orderBy(h, id_col)
    return samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def twins(samples: DataFrame) -> DataFrame:
    """Each sample with the next of its type, the last with the first; types of one sample have none."""
    w = Window.partitionBy("type").orderBy("ord")
    first = F.first("sample_id").over(w)
    df = samples.withColumn("partner", F.coalesce(F.lead("sample_id").over(w), first)).withColumn("n", F.count("*").over(Window.partitionBy("type")))
    return df.where("n > 1").drop("n")


def unique_ids(rows: DataFrame, base: str = "base", order: str = "ord") -> DataFrame:
    """A repeated base id gets a suffix, ``_002`` for its second row; from 1000 on the number is longer, never cut."""
    i = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("unique_id", F.when(i == 1, F.col(base)).otherwise(F.concat(F.col(base), F.format_string("_%03d", i))))


def matrix(spark, models: list[str], modalities: list[str], tasks: list[str], resolutions: list[int], seeds: list[int]) -> DataFrame:
    """All cells of an experiment, from fixed lists: the last dimension runs fastest."""
    one = spark.range(1)
    for name, values in (("model", models), ("modality", modalities), ("task", tasks), ("resolution", resolutions), ("seed", seeds)):
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return one.drop("id")
