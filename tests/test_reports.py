"""Quantiles, composed retrieval, upload votes and page geometry against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one", "same", "tiny"])
def test_exact_quantiles(spark, kind):
    from quillmill.operators.quantiles import exact_quantiles

    rng = random.Random(4)
    make = {
        "normal": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randrange(3)), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "one": lambda: 2.5, "same": lambda: -7.0, "tiny": lambda: 1.0 + rng.randrange(4) * 2.0**-52,
    }[kind]
    values = [make() for _ in range(1 if kind == "one" else 3000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    points = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)
    got = exact_quantiles(rows, "x", points)
    ordered = sorted(values)
    for p, v in got:
        at = (len(ordered) - 1) * p
        lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert v == (lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)
    assert exact_quantiles(rows.limit(0), "x", (0.5,)) == [(0.5, None)]


def test_quantiles_gather_bins_not_values(spark):
    """What reaches the driver is bounded by the bins, and no plan sorts or gathers the values."""
    from quillmill.operators import quantiles

    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("double").alias("x"))
    assert quantiles.order_statistics(rows, "x", [0, 99_999, 199_999]) == {0: 0.0, 99_999: 99_999.0, 199_999: 199_999.0}


def _chunks(spark):
    vector = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, vector(0.0), "law", None, "first text", "s1", "fr"), (2, vector(0.1), "law", None, "second text", "s2", "ar"), (3, vector(1.4), "law", None, "far text", "s3", "fr"), (4, vector(0.05), "tax", None, "other domain", "s4", "fr"), (5, vector(0.02), "tax", "u1", "upload", "s5", "fr")]
    return spark.createDataFrame(rows, "chunk_id long, vector array<double>, domain string, source_file_id string, content string, source string, language string")


def test_retrieve_backends(spark):
    from quillmill.operators.retrieval import retrieve

    asks = spark.createDataFrame([(100, "q", [1.0, 0.0], "law", "fr", None, ["u1"]), (101, None, None, "law", None, None, None), (102, "z", [0.0, -1.0], "law", "fr", "ar", None)], "query_id long, text string, vector array<double>, domain string, ui_lang string, target_language string, sources array<string>")
    got = {r.query_id: r for r in retrieve(asks, _chunks(spark), "indexed").collect()}
    assert got[100].sources == ["s1", "s5", "s2"] and got[100].context == "first text\n\n---\n\nupload\n\n---\n\nsecond text"  # far text is below 0.4
    assert got[101].context == "" and got[101].sources == [] and got[102].context == "" and not got[102].cross_language
    import hashlib

    assert got[100].fingerprint == hashlib.sha256(b"law|fr|q").hexdigest() and got[101].fingerprint == hashlib.sha256(b"law|None|None").hexdigest()
    local = {r.query_id: r for r in retrieve(asks, _chunks(spark), "local").collect()}
    assert local[100].sources == ["s1", "s2", "s3"] and len(local[102].sources) == 3 and local[102].cross_language
    with pytest.raises(ValueError, match="unknown retrieval backend"):
        retrieve(asks, _chunks(spark), "disk2")


def test_upload_files_vote_by_their_first_chunk(spark):
    from quillmill.operators.near_rows import embed, hashed_ngrams
    from quillmill.operators.retrieval import vote_upload_files

    topics = {"law": "tribunal judge appeal contract clause statute ", "sea": "harbour vessel anchor tide rudder sailor "}
    known = [(i, t, (body * 12)[i : i + 400]) for i, (t, body) in enumerate(list(topics.items()) * 6)]
    chunks = embed(spark.createDataFrame(known, "chunk_id long, domain string, content string"), F.col("content")).withColumn("source_file_id", F.lit(None).cast("string"))
    files = spark.createDataFrame([(1000, topics["sea"] * 30 + topics["law"] * 100), (1001, topics["law"] * 30), (1002, None), (1003, "  \n")], "query_id long, text string")
    got = {r.query_id: (r.domain, r.domain_source) for r in vote_upload_files(files, chunks, "general").collect()}
    assert got == {1000: ("sea", "retrieval"), 1001: ("law", "retrieval"), 1002: ("general", "no_match"), 1003: ("general", "no_match")}
    assert np.allclose(np.linalg.norm(hashed_ngrams(["abc def"]), axis=1), 1)


def test_page_signals_edges(spark):
    from quillmill.operators.pages import classify_pages, page_signals

    schema = "page int, text string, width_pt double, height_pt double, font_count int, images array<struct<px_w: int, px_h: int>>"
    rows = [
        (1, None, 595.0, 842.0, 0, None), (2, "x" * 500, 595.0, 842.0, 1, [(1240, 1754), (100, 100)]), (3, "x", 595.0, 842.0, 1, [(500, 700)]), (4, "x", 0.0, 842.0, 1, [(1240, 1754)]),
        (5, "x" * 500, 595.0, 842.0, 2, [(2000, 600), (0, 9)]), (6, "�" * 60 + "x" * 40, 595.0, 842.0, 2, []), (7, "x", 595.0, 842.0, 0, [(None, 5)]), (8, "x" * 500, 595.0, 842.0, None, [(595, 842)]),
    ]
    got = {r.page: r for r in classify_pages(page_signals(spark.createDataFrame(rows, schema))).collect()}
    assert {p: got[p].strategy for p in got} == {1: "empty", 2: "ocr_preferred", 3: "ocr_required", 4: "ocr_preferred", 5: "ocr_preferred", 6: "ocr_required", 7: "ocr_required", 8: "ocr_required"}
    assert got[2].full_raster_dpi == 150 and got[3].has_full_page_raster is False and got[4].page_area_in2 == 1.0 and got[5].max_image_megapixels == 1.2 and got[8].full_raster_dpi == 72
