"""Page strategies from page signals, ingest outcomes, and system prompts filled from a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bad_char_ratio

# The thresholds of the page ladder (characters for each square inch, share, megapixels).
UNUSABLE_DENSITY, EMPTY_DENSITY, MAX_BAD_CHARS, LARGE_IMAGE_MP = 3.0, 1.0, 0.10, 1.0
RASTER_MIN_DPI, RASTER_ASPECT_TOLERANCE, POINTS = 72, 0.15, 72
MAX_ERROR = 500


def page_signals(pages: DataFrame) -> DataFrame:
    """pages (…, text, width_pt, height_pt, font_count, images array<struct<px_w, px_h>>) with the signals that classify_pages()
    reads, from the page's box and the pixel boxes of its images.

    Density is characters of the trimmed text by square inch (an area of 0 counts as 1). An image is a raster of the full page
    if its aspect is within 15 % of the page's and its width gives 72 DPI or more; full_raster_dpi is the best of them,
    rounded. Images without pixels still count; a null list is empty, a null text too, a null side is 0.
    """
    side = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double") / POINTS
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    images = F.coalesce("images", F.array().cast(pages.schema["images"].dataType))
    out = pages.withColumns({"_w": side("width_pt"), "_h": side("height_pt"), "_t": text, "_images": images})
    area = F.when(F.col("_w") * F.col("_h") == 0, 1.0).otherwise(F.col("_w") * F.col("_h"))
    aspect = F.col("_w") / F.when(F.col("_h") != 0, F.col("_h"))
    dpi = lambda i: i["px_w"] / F.when(F.col("_w") != 0, F.col("_w"))
    fits = lambda i: (i["px_w"] > 0) & (i["px_h"] > 0) & (aspect > 0) & (F.abs(i["px_w"] / F.when(i["px_h"] != 0, i["px_h"]) - aspect) / aspect <= RASTER_ASPECT_TOLERANCE) & (dpi(i) >= RASTER_MIN_DPI)
    best = F.array_max(F.transform(F.filter("_images", lambda i: F.coalesce(fits(i), F.lit(False))), dpi))
    pixels = F.transform("_images", lambda i: F.coalesce(i["px_w"].cast("double") * i["px_h"] / 1_000_000, F.lit(0.0)))
    return out.withColumns(
        {
            "char_count": F.length("_t"), "page_area_in2": area, "char_density": F.length("_t") / area, "image_count": F.size("_images"), "has_full_page_raster": best.isNotNull(), "full_raster_dpi": F.bround(best).cast("int"),
            "bad_char_ratio": bad_char_ratio(F.col("_t")), "max_image_megapixels": F.coalesce(F.array_max(pixels), F.lit(0.0)), "font_count": F.coalesce("font_count", F.lit(0)),
        }
    ).drop("_w", "_h", "_t", "_images")


def classify_pages(signals: DataFrame) -> DataFrame:
    """signals with strategy (empty, ocr_required, ocr_preferred, native) and a reason code.

    Needs char_density, font_count, image_count, has_full_page_raster, bad_char_ratio, max_image_megapixels; a null
    signal counts as zero or false.
    """
    number = lambda name: F.coalesce(F.col(name), F.lit(0))
    fonts, images, density, raster = number("font_count"), number("image_count"), number("char_density"), F.coalesce("has_full_page_raster", F.lit(False))
    ladder = [
        ((fonts == 0) & (images == 0), "empty", "nothing_on_page"),
        (fonts == 0, "ocr_required", "no_text_layer"),
        (raster & (density < UNUSABLE_DENSITY), "ocr_required", "scan"),
        (raster, "ocr_preferred", "raster_with_text"),
        (number("bad_char_ratio") > MAX_BAD_CHARS, "ocr_required", "broken_encoding"),
        ((density < EMPTY_DENSITY) & (images > 0), "ocr_required", "image_without_text"),
        (density < EMPTY_DENSITY, "empty", "negligible_text"),
        (number("max_image_megapixels") >= LARGE_IMAGE_MP, "ocr_preferred", "large_image"),
    ]

    def pick(at: int, last: str) -> Column:
        chosen = F.when(ladder[0][0], ladder[0][at])
        for rung in ladder[1:]:
            chosen = chosen.when(rung[0], rung[at])
        return chosen.otherwise(last)

    return signals.withColumn("strategy", pick(1, "native")).withColumn("reason", pick(2, "usable_text"))


def ingest_outcome(files: DataFrame) -> DataFrame:
    """(id, status, error_message, pages_done) of files (id, n_chunks, n_unprocessed, failure): a failure or no chunk is an
    error, unprocessed pages make it partial, else it is ready; the progress counter is cleared."""
    message = F.when(F.col("failure").isNotNull(), F.substring("failure", 1, MAX_ERROR)).when(F.coalesce("n_chunks", F.lit(0)) == 0, "no chunks")
    status = F.when(message.isNotNull(), "error").when(F.coalesce("n_unprocessed", F.lit(0)) > 0, "partial").otherwise("ready")
    return files.select("id", status.alias("status"), message.alias("error_message"), F.lit(None).cast("int").alias("pages_done"))


def fill_system_prompt(template: str, domain: Column, context: Column) -> Column:
    """The template with {domain} and then {context} filled in; braces inside the values stay as they are."""
    head, rest = template.split("{domain}", 1)
    middle, tail = rest.split("{context}", 1)
    return F.concat(F.lit(head), F.coalesce(domain, F.lit("")), F.lit(middle), F.coalesce(context, F.lit("")), F.lit(tail))


def prompt_parity(rows: DataFrame, template: str) -> DataFrame:
    """One row: n_rows and n_match, the rows whose `system` starts with the template's head before {domain}."""
    head = template.split("{domain}", 1)[0]
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.coalesce(F.startswith("system", F.lit(head)), F.lit(False)).cast("long")), F.lit(0)).alias("n_match"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc, text, unprocessed, page_count, ocr_pages, parser, failed) of pages (doc, page, strategy, native, ocr, error).

    An empty page has no text, a native one its own, ocr_preferred joins its own and the recognised one, ocr_required takes
    the recognised one. Pages follow as `## Page n` sections; unprocessed lists (page, reason) of those left without text:
    empty_page, the recogniser's error, or no_text_extracted. A document fails if no page has text and some had an error.
    """
    native, read = (F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(" \t\n\x0b\f\r")) for c in ("native", "ocr"))
    both = F.array_join(F.filter(F.array(native, read), lambda t: t != ""), "\n\n")
    text = F.when(F.col("strategy") == "empty", "").when(F.col("strategy") == "ocr_required", read).when(F.col("strategy") == "ocr_preferred", both).otherwise(native)
    asks = F.col("strategy").isin("ocr_required", "ocr_preferred")
    reason = F.when(F.col("strategy") == "empty", "empty_page").when(asks & F.col("error").isNotNull(), F.col("error")).otherwise("no_text_extracted")
    rows = pages.select("doc", F.struct("page", text.alias("text"), reason.alias("reason")).alias("p"), (F.col("strategy") != "native").alias("odd"), (asks & F.col("error").isNotNull()).alias("bad"))
    whole = rows.groupBy("doc").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.count("*").alias("page_count"), F.count_if("odd").alias("ocr_pages"), F.count_if("bad").alias("n_bad"))
    left = F.transform(F.filter("ps", lambda p: p["text"] == ""), lambda p: F.struct(p["page"].alias("page"), p["reason"].alias("reason")))
    parser = F.when(F.col("ocr_pages") == 0, "pdf_text").when(F.col("ocr_pages") == F.col("page_count"), "pdf_ocr").otherwise("pdf_mixed")
    return whole.select(
        "doc", F.array_join(F.transform("ps", lambda p: F.concat(F.lit("## Page "), p["page"].cast("string"), F.lit("\n\n"), p["text"])), "\n\n").alias("text"), left.alias("unprocessed"), "page_count", "ocr_pages", parser.alias("parser"),
        (~F.exists("ps", lambda p: p["text"] != "") & (F.col("n_bad") > 0)).alias("failed"),
    )
