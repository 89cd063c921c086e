import base64
import gzip
import os
import random
import urllib.parse

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "pan", "Über", "él", "tion", "house,", "x1", "naïve", "ﬁn", "的", "qu'il", "don't", "50%"] + ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = prose(60), prose(200)
    secret = "AKIA" + "Z9" * 9
    twice = urllib.parse.quote(urllib.parse.quote("password=hunter2hunter2"))
    texts = [
        None, "", " \n\t ", "word", "two words", "a b a b a b a b " * 30, base, base, base + " tail", base.replace(" the ", " teh ", 2),
        prose(80) + " " + passage + " " + prose(80), passage + " " + prose(20), prose(40) + passage, "line one\nline one\n\nline two\n \nline one",
        f"key {secret} token = \"abcdef123\" api-key: none api_key:abcdefg SECRET:abc secret=token:abcdefgh", "blob " + base64.b64encode(f"my {secret} here".encode()).decode() + " end",
        "blob " + base64.b64encode(gzip.compress(b"passwd: correct-horse", mtime=0)).decode(), f"url {twice} end", "uni \\u0070assword=abcdefgh", "deadbeef" * 4, "ab" * 400, "é" * 150 + "x", "\t\x0b a▁b  c \n\n d　e 😀 <s> </s>",
        "".join(rng.choices("abc", k=5000)), prose(3000), "x" * 30000, "<|endoftext|> 's it'S ΑΣ Σ",
    ]
    return texts


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source, n_chars): null, empty and blank texts, copies, near copies, shared passages, a null id
    and a repeated row."""
    rows = [(i * 7 % 101, t, ("en", "fr", None)[i % 3], "src0", len(t or "")) for i, t in enumerate(_texts())]
    return [*rows, (None, "no id, some words", "en", "s", 5), rows[6], rows[6]]


def write_edge(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, rows[10][1].split(" ", 80)[80][:400]), (2, None), (3, ""), (4, "two words"), (4, "two words"), (None, "two words"), (5, "--- !"), (6, "Word")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory, edge_rows):
    folder = str(tmp_path_factory.mktemp("edge"))
    write_edge(spark, folder, edge_rows)
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(params=["edge", "sf"])
def docs_dir(request, edge_dir):
    return edge_dir if request.param == "edge" else SF
