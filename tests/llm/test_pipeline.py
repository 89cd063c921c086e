"""run() against plain Python; only the quality verdicts, tested elsewhere, come from the operator."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from quillmill.llm import secret_scan
from quillmill.llm.quality_rules import quality_rules

from .conftest import SF
from .test_operators import slow_hits, table


def five_words(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or (a and b and len(a & b) >= 0.8 * len(a | b))


def slow_copies(docs):
    """The smallest id reachable over all pairs of 0.8 similarity or more."""
    sets = {d: five_words(t) for d, t in docs.items()}
    label, moved = {d: d for d in docs}, True
    pairs = [(a, b) for a in docs for b in docs if a < b and alike(sets[a], sets[b])]
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != label[b]
            label[a] = label[b] = low
    return label


def test_near_copies_find_what_brute_force_finds(spark):
    from quillmill.llm.near_copies import near_copies

    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(600)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one three")]
    for _ in range(12):  # groups of copies with up to six words changed, dropped or put in
        base = prose(rng.choice((60, 200, 600)))
        for _ in range(rng.choice((2, 3, 9))):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                i = rng.randrange(len(words))
                words[i : i + rng.randint(0, 2)] = prose(rng.randint(0, 2))
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(prose(100))) for i in range(40)]
    docs = dict(rows)
    frame = spark.createDataFrame([*rows, (3, "one two"), (None, "one two")], "doc_id long, text string")
    got = near_copies(frame).collect()
    assert len(got) == len(rows) + 2 and sum(r.doc_id is None and r.component_id == 3 for r in got) == 1
    want = slow_copies(docs)
    found = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert all(found[d] >= want[d] for d in docs)  # never more than brute force
    copies = [d for d in docs if want[d] != d]
    assert len(copies) > 20 and sum(found[d] != d for d in copies) >= 0.95 * len(copies)
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_in_one_crowded_bucket(spark):
    """Two large groups and strangers that all differ little in their signatures end up in the right components."""
    from quillmill.llm import near_copies as nc

    rng = random.Random(4)
    base = [[f"w{rng.randrange(900)}" for _ in range(300)] for _ in range(2)]
    rows = []
    for i in range(160):
        words = list(base[i % 2])
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 2 for i in range(160)}


def test_run_equals_plain_python(spark):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kept = {r.doc_id for r in quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF) if r["doc_id"] in kept}
    label = slow_copies(docs)
    windows = defaultdict(set)
    for r in table(spark, SF, "benchmark"):
        words = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in r["text"]).encode().lower().decode().split()
        for i in range(max(1, len(words) - 9)):
            windows[tuple(words[i : i + 10])].add(str(r["item_id"]))
    want = set()
    for d, t in docs.items():
        if label[d] == d and not slow_hits(t, windows)[1]:
            ids = sp.encode(secret_scan.mask(t, secret_scan.scan(t)[1]), add_bos=True, add_eos=True)
            want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_on_null_and_repeated_ids(spark, tmp_path):
    import random

    import corpus_pipeline as cp

    rng = random.Random(3)
    vocabulary = ["the", "of", "and", *("".join(rng.choices("abcdefghij", k=6)) for _ in range(400))]
    text = lambda: " ".join(rng.choices(vocabulary, k=120))
    a, b, c, d, e, bench, schema = text(), text(), text(), text(), text(), text(), "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema), str(tmp_path)).collect()), key=str)
    order = lambda rows: sorted(rows, key=str)
    assert run(cp.quality, [(None, a), (1, b), (1, "too short"), (2, c), (2, c), (None, "short"), (3, None)]) == order([(None, a), (1, b), (2, c), (2, c)])
    assert run(cp.near_dedup, [(None, a), (None, b), (1, c), (1, d), (2, e), (2, e), (None, c), (3, d)]) == order([(None, a), (None, b), (1, c), (1, d), (2, e)])
    assert run(cp.decontamination, [(None, a), (None, bench), (1, b), (1, bench), (2, None)]) == order([(None, a), (1, b), (2, None)])
    secret = "password=Tr0ub4dor-and-3"
    assert run(cp.secrets, [(None, a), (None, f"x {secret} y"), (1, b), (1, f"z {secret}"), (2, None), (2, c), (2, c)]) == order([(None, a), (None, "x [SECRET] y"), (1, b), (1, "z [SECRET]"), (2, None), (2, c), (2, c)])


def test_stages_on_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    names = ["_key", "_digest", "redacted", "ids", "kept", "component_id", "id", "t", "digest", "row", "spans"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    text = " ".join(f"w{i * i % 97}x{i}" for i in range(150))
    rows = spark.createDataFrame([(1, text, "en", "s", 5, *[f"{n}!" for n in names])], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, rows, str(tmp_path))
        assert got.columns == rows.columns and [r[f"{n}"] for r in got.collect() for n in names] == [f"{n}!" for n in names]
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
    assert cp.STAGES[-1][1](spark, rows, str(tmp_path)).count() == 1 and cp.STAGES[-1][1](spark, rows.limit(0), str(tmp_path)).count() == 0


def test_near_copies_below_the_limit_meet_seldom(spark, monkeypatch):
    """Texts of one group that are all a little too different are not joined pair by pair, and what is similar enough is still found."""
    from quillmill.llm import near_copies as nc

    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(200):
        words = list(base)
        for j in (rng.randrange(70), rng.randrange(75, 150)):  # ten shingles of 146 each: about 0.76 for two of them
            words[j] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows.append((200, rows[7][1] + " more"))
    counts = []

    def settle(df, label="scratch", plain=nc.settle):
        out = plain(df, label)
        counts.extend([out.count()] if label == "candidates" else [])
        return out

    monkeypatch.setattr(nc, "settle", settle)
    found = {r.doc_id: r.component_id for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = slow_copies(dict(rows))
    assert found == want and want[200] != 200
    assert sum(counts) < 6000  # of 20,100 pairs; those that share an edited place or nearly so are similar enough


def test_near_copies_bounds_pass_similar_pairs(spark):
    """Pairs of the similarity share a rare shingle, their places there and their parities pass, whatever the order of shingles."""
    import numpy as np
    from pyspark.sql import functions as F

    from quillmill.llm import near_copies as nc

    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        size = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[: size - int(rng.integers(0, 1 + size // 8))], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 9)), dtype=np.uint64)])
        rows += [(2 * k + i, nc.packed(np.unique(x))) for i, x in enumerate((a, b))]
    sets = {i: set(nc.unpacked(x).tolist()) for i, x in rows}
    alike = [i for i in range(0, 600, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    frame = spark.createDataFrame(rows, "node long, shingles binary")
    keys = nc.rare_shingles(frame, 0.8).cache()
    other = keys.select("key", (F.col("node") - 1).alias("node"), F.col("at").alias("to"))
    met = {r.node for r in keys.where("node % 2 = 0").join(other, ["key", "node"]).where(nc.reaching("at", "to", 0.8)).select("node").distinct().collect()}
    assert len(alike) > 80 and met.issuperset(alike)
    odd = dict(rows)
    for i in alike:
        apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(nc.parities(odd[i]), nc.parities(odd[i + 1]), strict=True))
        assert apart <= len(sets[i] ^ sets[i + 1])


def test_near_copies_with_far_fingerprints_are_joined(spark, tmp_path):
    """Four of five shingles in common, so 0.8 similarity, but fingerprints further apart than nearly all such pairs have them."""
    import corpus_pipeline as cp

    from quillmill.llm import near_copies as nc

    a = "one of the 1625 texts that are alike"
    b, other = a + " w547", "two words that stand in none of these texts"
    prints = [nc.block_fingerprints(nc.shingle_hashes(t.encode())) for t in (a, b)]
    assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*prints, strict=True)) > nc.bits_apart(0.8)
    rows = spark.createDataFrame([(1, a), (2, b), (3, other)], "doc_id long, text string")
    want = slow_copies({1: a, 2: b, 3: other})
    assert {r.doc_id: r.component_id for r in nc.near_copies(rows).collect()} == want == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in cp.near_dedup(spark, rows, str(tmp_path)).collect()) == [1, 3]
