"""Lines, skew and confidence from OCR words: numbers are read leniently, words are grouped by line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import strip

LINE = ("block_num", "par_num", "line_num")
# Fixed values that results depend on.
WORD_LEVEL, SKEW_LIMIT, SKEW_POINTS, SKEW_ALERT = "5", 8, 3, 0.7
GAP, GAP_HEIGHTS = 12, 1.5
RED, RED_LEAD, RED_ALERT = 180, 70, 0.0005


def lenient_int(text: Column) -> Column:
    """A whole number, decimals cut off; 0 for anything else."""
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(0))


def lenient_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def read_words(raw: DataFrame) -> DataFrame:
    """Typed words of (doc_id, ordinal and twelve text columns) rows: word level only, none blank."""
    numbers = ("page_num", *LINE, "left", "top", "width", "height")
    kept = raw.where((F.col("level") == WORD_LEVEL) & (strip(F.coalesce("text", F.lit(""))) != ""))
    typed = {c: lenient_int(F.col(c)) for c in numbers} | {"conf": lenient_float(F.col("conf"), -1), "text": strip(F.col("text"))}
    return kept.withColumns(typed)


def mean_confidence(conf: Column) -> Column:
    """The mean of the confidences there are, as a share of 1; null without any."""
    return F.avg(F.when(conf >= 0, conf)) / 100


def text_blocks(words: DataFrame, page_width: float, page_height: float, dpi: int) -> DataFrame:
    """A block for each line of words, numbered by first appearance; wide gaps become tabs.

    `words` are typed words of single pages: doc_id, page_index, ordinal (their order) and the rest.
    """
    page = ("doc_id", "page_index")
    pixels = [F.greatest(F.lit(1), F.bround(F.lit(side * dpi / 72.0), 0)) for side in (page_width, page_height)]
    across, down = F.lit(page_width) / pixels[0], F.lit(page_height) / pixels[1]
    line = Window.partitionBy(*page, *LINE)
    along = line.orderBy("left", "ordinal")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(along)
    joint = F.when(gap.isNull(), "").when(gap > F.greatest(F.lit(float(GAP)), GAP_HEIGHTS * F.col("__tall")), "\t").otherwise(" ")
    placed = words.withColumn("__tall", F.percentile("height", 0.5).over(line)).withColumn("__n", F.row_number().over(along)).withColumn("__part", F.concat(joint, "text"))
    lines = placed.groupBy(*page, *LINE).agg(
        F.min("ordinal").alias("__first"),
        (F.min("left") * across).alias("x0"),
        (F.min("top") * down).alias("y0"),
        (F.max(F.col("left") + F.col("width")) * across).alias("x1"),
        (F.max(F.col("top") + F.col("height")) * down).alias("y1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__part"))), lambda p: p["__part"]), "").alias("text"),
        mean_confidence(F.col("conf")).alias("ocr_confidence"),
    )
    number = F.row_number().over(Window.partitionBy(*page).orderBy("__first")) - 1
    return lines.select(*page, number.alias("block_ordinal"), F.lit(0).alias("block_type"), "text", "x0", "y0", "x1", "y1", "ocr_confidence")


def skew(words: DataFrame) -> DataFrame:
    """(doc_id, page_index, skew_degrees): the median slope of the lines' word centres, of lines with three words or more."""
    keys = ("doc_id", "page_index", "page_num", *LINE)
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    slopes = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("spread"), F.regr_slope(y, x).alias("slope"))
    angle = F.degrees(F.atan("slope"))
    usable = (F.col("n") >= SKEW_POINTS) & (F.col("spread") > 0) & (F.abs(angle) <= SKEW_LIMIT)
    middle = F.percentile(F.when(usable, angle), 0.5)
    return slopes.groupBy("doc_id", "page_index").agg(F.coalesce(F.bround(middle, 3), F.lit(0.0)).alias("skew_degrees"))


def is_skewed(degrees: Column) -> Column:
    return F.abs(degrees) >= SKEW_ALERT


def is_red(r: Column, g: Column, b: Column) -> Column:
    return (r >= RED) & (r - g >= RED_LEAD) & (r - b >= RED_LEAD)


def red_share(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, red_ratio, has_red_annotations) of pixel rows (r, g, b)."""
    share = F.avg(is_red(F.col("r"), F.col("g"), F.col("b")).cast("double"))
    return pixels.groupBy(*keys).agg(share.alias("red_ratio")).withColumn("has_red_annotations", F.col("red_ratio") >= RED_ALERT)


def red_share_of_images(images: DataFrame) -> DataFrame:
    """(image_id, red_ratio) of (image_id, channels, data) rows, whose data are raw interleaved bytes.

    Fewer than three channels and unreadable data give 0.
    """
    @F.pandas_udf("double")
    def share(channels: pd.Series, data: pd.Series) -> pd.Series:
        import numpy as np

        def one(n: int, raw: bytes | None) -> float:
            if raw is None or n is None or n < 3 or len(raw) == 0 or len(raw) % n:
                return 0.0
            p = np.frombuffer(raw, np.uint8).reshape(-1, int(n)).astype(int)
            return float(((p[:, 0] >= RED) & (p[:, 0] - p[:, 1] >= RED_LEAD) & (p[:, 0] - p[:, 2] >= RED_LEAD)).mean())

        return pd.Series([one(n, raw) for n, raw in zip(channels, data)], dtype="float64")

    return images.select("image_id", share("channels", "data").alias("red_ratio"))


def red_share_of_png(images: DataFrame) -> DataFrame:
    """(image_id, red_ratio, has_red_annotations) of (image_id, content, box, width, height) rows: PNG bytes and a part of the page.

    The box, in the page's units (`width`, `height`), is cut to the page and counts with every pixel that it touches; a null
    box is the whole image. Colours count times their alpha. Grey images and unreadable bytes give 0, a box without an area
    on its page is null.
    """
    from quirelake.operators.detection import intersect_page

    @F.pandas_udf("double")
    def share(content: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        import numpy as np

        from quirelake.functions import png

        def one(data: bytes | None, *box: float) -> float:
            try:
                pixels = png.on_black(png.decode(data or b""))
            except png.NotPng:
                return 0.0
            if pixels.shape[2] < 3:
                return 0.0
            high, wide = pixels.shape[:2]
            left, top = int(np.floor(box[0] * wide)), int(np.floor(box[1] * high))
            part = pixels[top : max(top + 1, int(np.ceil(box[3] * high))), left : max(left + 1, int(np.ceil(box[2] * wide)))]
            r, g, b = (part[..., c].astype(np.int16) for c in range(3))
            return float(((r >= RED) & (r - g >= RED_LEAD) & (r - b >= RED_LEAD)).mean())

        return pd.Series([one(*row) for row in zip(content, x0, y0, x1, y1)], dtype="float64")

    part = intersect_page(F.col("box"), F.col("width"), F.col("height"))
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    shares = F.struct((part["x0"] / F.col("width")).alias("x0"), (part["y0"] / F.col("height")).alias("y0"), (part["x1"] / F.col("width")).alias("x1"), (part["y1"] / F.col("height")).alias("y1"))
    at = images.select("image_id", "content", F.when(F.col("box").isNull(), whole).when(part.isNotNull(), shares).alias("at"), (F.col("box").isNotNull() & part.isNull()).alias("off"))
    # a box off its page is worked out as the whole image, and then left out
    edges = [F.coalesce(F.col(f"at.{c}"), whole[c]) for c in ("x0", "y0", "x1", "y1")]
    return at.select("image_id", F.when(~F.col("off"), share("content", *edges)).alias("red_ratio")).withColumn("has_red_annotations", F.col("red_ratio") >= RED_ALERT)
