"""Figure layer: perceptual hashes, correlation and template search over pairs of figures.

Hamming distances and the verdict's cheap branches are built-in expressions; the template search
runs only on pairs that those leave open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import images as I
from ..model import FIGURE_VERDICTS, ImageParams

PAIR = ["a_doc", "b_doc"]
HASHES = "struct<phash:bigint,dhash:bigint,blank:boolean,thumb:array<float>,gray:array<float>,gh:int,gw:int>"


def figure_hash(params: ImageParams = ImageParams()):
    """An Arrow function of ``height, width, channels, data`` to the fields of ``HASHES``."""

    @F.pandas_udf(HASHES)
    def hashes(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for h, w, c, raw in zip(height, width, channels, data, strict=True):
            if raw is None:
                rows.append((None, None, False, None, None, 0, 0))
                continue
            pixels = np.frombuffer(raw, np.uint8).reshape(h, w, c)
            image = I.grey(pixels[..., 2::-1] if c >= 3 else np.repeat(pixels[..., :1], 3, axis=2))
            image = I.fit_within(image, params.max_side)
            if image.std() < params.min_std:
                rows.append((0, 0, True, None, None, 0, 0))
                continue
            small = I.fit_within(image, I.CROP_SIDE)
            rows.append((I.phash(image), I.dhash(image), False, I.thumbnail(image).astype("f4").reshape(-1), small.astype("f4").reshape(-1), *small.shape))
        return pd.DataFrame(rows, columns=["phash", "dhash", "blank", "thumb", "gray", "gh", "gw"]).astype({"phash": "Int64", "dhash": "Int64"})

    return hashes


def hash_figures(figures: DataFrame, params: ImageParams = ImageParams()) -> DataFrame:
    """``figures`` with ``phash, dhash, blank, thumb, gray, gh, gw``.

    Pixels are ``height, width, channels, data`` as Spark's image source has them (BGR rows).  A
    nearly even image is blank and has no hashes.  A figure without pixels, as of a coding that isn't read here, has
    no hashes either and can only be an exact copy.
    """
    return figures.withColumn("_h", figure_hash(params)("height", "width", "channels", "data")).select("*", "_h.*").drop("_h")


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as ``figure_hash`` and ``crop_score``."""
    spark.udf.register("figure_hash", figure_hash())
    spark.udf.register("crop_score", crop_either_way)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@F.pandas_udf(DoubleType())
def crop_either_way(a: pd.Series, ah: pd.Series, aw: pd.Series, b: pd.Series, bh: pd.Series, bw: pd.Series) -> pd.Series:
    """The better ``crop_score`` of two grey images in each other."""
    out = []
    for x, xh, xw, y, yh, yw in zip(a, ah, aw, b, bh, bw, strict=True):
        p, q = np.asarray(x, float).reshape(int(xh), int(xw)), np.asarray(y, float).reshape(int(yh), int(yw))
        out.append(max(I.crop_score(p, q), I.crop_score(q, p)))
    return pd.Series(out, dtype="float64")


def quick_verdict(pd_: Column, dd: Column, same_bytes: Column, params: ImageParams = ImageParams()) -> Column:
    """exact or same, or null where only a search can tell."""
    return F.when(same_bytes, "exact").when((pd_ <= params.phash_threshold) & (dd <= params.dhash_threshold), "same")


def rank_candidates(rows: DataFrame) -> DataFrame:
    """Of each A figure its best partner, and every other one that isn't merely similar."""
    order = F.array_position(F.array(*[F.lit(v) for v in FIGURE_VERDICTS]), F.col("verdict"))
    best = Window.partitionBy(*PAIR, "a_id").orderBy(order, "phash_distance", F.desc("crop_ncc"), "b_id")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank = 1 or verdict <> 'similar'")


def compare(a: DataFrame, b: DataFrame, pairs: DataFrame, params: ImageParams = ImageParams()) -> DataFrame:
    """Figure matches of hashed figures for the given document pairs."""
    names = ["id", "page", "bbox", "sha256", "caption", "phash", "dhash", "thumb", "gray", "gh", "gw"]
    side = lambda df, s: df.where("not blank").select(F.col("doc_id").alias(f"{s}_doc"), *[F.col(c).alias(f"{s}_{c}") for c in names])
    both = pairs.select(*PAIR).join(side(a, "a"), "a_doc").join(side(b, "b"), "b_doc")
    dot = F.aggregate(F.zip_with("a_thumb", "b_thumb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = both.withColumns({"phash_distance": hamming(F.col("a_phash"), F.col("b_phash")), "dhash_distance": hamming(F.col("a_dhash"), F.col("b_dhash")), "ncc": F.round(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)), 3)})
    both = both.withColumn("verdict", quick_verdict(F.col("phash_distance"), F.col("dhash_distance"), F.col("a_sha256") == F.col("b_sha256"), params))
    told = both.where("verdict is not null").withColumns({"crop_ncc": F.when(F.col("verdict") == "exact", 1.0).otherwise(F.col("ncc")), "ncc": F.coalesce("ncc", F.lit(1.0)), "phash_distance": F.coalesce("phash_distance", F.lit(0)), "dhash_distance": F.coalesce("dhash_distance", F.lit(0))})
    rest = both.where("verdict is null and a_gray is not null and b_gray is not null").withColumn("crop_ncc", crop_either_way("a_gray", "a_gh", "a_gw", "b_gray", "b_gh", "b_gw"))
    rest = rest.withColumn("verdict", F.when(F.col("crop_ncc") >= params.crop_ncc, "cropped").when(F.col("phash_distance") <= params.similar_threshold, "similar")).where("verdict is not null")
    rows = told.unionByName(rest.select(*told.columns)).withColumn("crop_ncc", F.round("crop_ncc", 3))
    return rank_candidates(rows).select(*PAIR, "a_id", "b_id", "verdict", "phash_distance", "dhash_distance", "ncc", "crop_ncc", "a_page", "b_page", "a_caption", "b_caption", "a_bbox", "b_bbox")
