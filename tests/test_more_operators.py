"""Operators that SQL cannot express, or only in part, against plain Python on small rows."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


def turns_of(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


def test_gate_cascade_equals_the_loop_and_its_plan_stays_linear(spark):
    from quillmill.operators.planning import gate_cascade

    rng = random.Random(1)
    rows = [(i, rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(1 << 20)) for i in range(400)]
    frame = spark.createDataFrame(rows, "ord long, component string, bits long")
    budgets = [rng.choice([0, 1, 3, 10, 1000]) for _ in range(20)]
    gates = [(f"g{i}", F.expr(f"if(bits % 97 = 0, null, bits & {1 << i} = {1 << i} AND bits % 3 = {i % 3})"), F.lit(b)) for i, b in enumerate(budgets)]
    used, want = defaultdict(int), {}
    for o, c, bits in rows:
        want[o] = None
        for i, b in enumerate(budgets):
            if bits % 97 and bits & (1 << i) and bits % 3 == i % 3 and used[c, i] < b:
                used[c, i] += 1
                want[o] = f"g{i}"
                break
    got = gate_cascade(frame, gates)
    assert {r.ord: r.reject_reason for r in got.collect()} == want
    assert got._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert gate_cascade(frame.limit(0), gates).count() == 0 and gate_cascade(frame, []).where("reject_reason IS NOT NULL").count() == 0


def test_top_k_filters_ids_and_nulls(spark):
    from quillmill.operators.retrieval import top_k

    rng = np.random.default_rng(3)
    rows = [(f"c{i}", None if i % 17 == 0 else [float(x) for x in rng.standard_normal(8).round(1)], ("law", "tax", None)[i % 3], None if i % 4 else f"f{i % 5}", f"t{i % 2}") for i in range(300)]
    asks = [(f"c{i}", None if i == 3 else [float(x) for x in rng.standard_normal(8)], ("law", None)[i % 2], f"t{i % 2}", (None, [], ["f0", "f3"])[i % 3]) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<double>, domain string, source_file_id string, tenant_id string").repartition(3)
    queries = spark.createDataFrame(asks, "query_id string, vector array<double>, domain string, tenant_id string, sources array<string>")
    want = set()
    for q, v, d, t, some in asks:
        fits = []
        for c, w, e, f, u in rows:
            if v is None or w is None or c == q or u != t or (d is not None and e != d and f is None) or (some is not None and f is not None and f not in some):
                continue
            norm = max(np.linalg.norm(v), 1e-9) * max(np.linalg.norm(w), 1e-9)
            fits.append((-round(float(np.dot(v, w) / norm), 9), c))
        want |= {(q, c, i + 1) for i, (_, c) in enumerate(sorted(fits)[:5])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in top_k(queries, chunks, 5).collect()} == want
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in top_k(queries, chunks, 5, max_queries=4).collect()} == want


def test_near_dedup_equals_the_scan(spark):
    from quillmill.operators.near_rows import leakage_pairs, near_dedup, near_pairs

    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 6))
    vectors = [base[rng.integers(12)] + 0.15 * rng.standard_normal(6) for _ in range(150)] + [base[0], base[0] * 3, np.zeros(6)]
    rows = [(i, None if i == 7 else [float(x) for x in v], "train" if i % 3 else "eval") for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "ord long, vector array<double>, split string")
    cosine = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    pairs = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and a and b and cosine(a, b) >= 0.95}
    kept = []
    for i, v, _ in rows:
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    assert {(r.i, r.j) for r in near_pairs(frame, 0.95).collect()} == pairs
    assert sorted(r.ord for r in near_dedup(frame, 0.95).collect()) == kept
    assert {(r.train, r.eval) for r in leakage_pairs(frame, 0.95).collect()} == {(i, j) if i % 3 else (j, i) for i, j in pairs if (i % 3 == 0) != (j % 3 == 0)}
    assert near_dedup(frame.limit(0), 0.95).count() == 0


def _loop(vectors, t):
    """The scan, row by row."""
    kept = []
    for i, v in enumerate(vectors):
        if all(float(v @ vectors[k]) < t for k in kept):
            kept.append(i)
    return kept


def test_near_dedup_query_equals_a_loop(spark):
    from quillmill.plans import catalogue

    sf = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = sorted(r.ord for r in catalogue.queries()["i2_near_dedup"](spark, sf).collect())
    assert got == [rows[i].vec_id for i in _loop(unit, 0.35)]


def _grouped(n, rng, dim=8):
    """Groups of eight near rows, some of them equal, around centres of their own."""
    centres = rng.standard_normal((n // 8, dim))
    v = np.repeat(centres, 8, axis=0) + 0.04 * rng.standard_normal((n, dim)) * rng.choice([0, 1, 3], (n, 1))
    return v[rng.permutation(n)]


def test_near_pairs_meet_few_rows(spark):
    """Pairs equal brute force; what meets grows far slower than the square of the rows."""
    from quillmill.operators import near_rows as N

    met = {}
    for n in (1000, 4000):
        v = _grouped(n, np.random.default_rng(7))
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "ord long, vector array<double>")
        first = N.settle(N.first_copies(frame), "firsts")
        distinct = first.count()
        radius = float(np.sqrt(0.1))
        pivots = N._pivots(first, radius, distinct)
        cells = N._cells(first.withColumn("side", F.lit(None).cast("string")), pivots, radius)
        sizes = cells.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g")).collect()
        met[n] = sum(r.h * (r.h + r.g) for r in sizes)
        assert sum(r.h for r in sizes) == distinct and len(pivots) > 10
        _, firsts = np.unique(unit.round(12), axis=0, return_index=True)
        sims = unit @ unit.T
        want = {(i, j) for i in firsts for j in firsts if i < j and sims[i, j] >= 0.95}
        got = [(r.i, r.j) for r in N.near_links(first, 0.95, block=64).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert met[1000] < 0.2 * 1000**2 and met[4000] < 8.5 * met[1000], met


def test_near_pairs_of_many_copies(spark):
    """A thousand equal rows give a pair each, not half a million; null and zero vectors none."""
    from quillmill.operators import near_rows as N

    rows = [(i, [1.0, 2.0, 2.0]) for i in range(1000)] + [(2000, [2.0, 4.0, 4.0]), (2001, None), (2002, [0.0, 0.0, 0.0]), (2003, [0.0, 1.0, 0.0]), (2004, [1.0, 2.0, 2.1])]
    frame = spark.createDataFrame(rows, "ord long, vector array<double>").withColumn("cell", F.lit(1)).withColumn("home", F.lit("x"))
    assert sorted((r.i, r.j) for r in N.near_pairs(frame, 0.95).collect()) == sorted([(0, i) for i in range(1, 1000)] + [(0, 2000), (0, 2004)])
    assert sorted(r.ord for r in N.near_dedup(frame, 0.95).collect()) == [0, 2001, 2002, 2003]
    split = frame.withColumn("split", F.when(F.col("ord") % 2 == 0, "train").otherwise("eval"))
    assert {(r.train, r.eval, r.train_copies, r.eval_copies) for r in N.leakage_pairs(split, 0.95).collect()} == {(0, 1, 501, 500), (2004, 1, 1, 500)}


def test_near_pairs_queries_keep_every_copy(spark, tmp_path, monkeypatch):
    """Copies, scaled copies and repeated ids are paired as in SQL, in blocks too; so are vectors without a direction, null ones are not."""
    from quillmill.operators import near_rows as N
    from quillmill.plans import catalogue

    from .harness import compare

    monkeypatch.setattr(N, "COPIES_A_BLOCK", 4)
    rng = np.random.default_rng(11)
    base = [[float(x) for x in v] for v in rng.integers(-3, 4, (6, 5))]
    near = [[x + 0.5 for x in base[0]], [7.0, 18.0, 5.0, 1.0, 1.0], [1.0, 0.0, 0.0, 0.0, 0.0]]  # the last two are 7 / 20 apart
    vectors = [base[0]] * 23 + [[2 * x for x in base[0]]] * 3 + [base[i % 6] for i in range(12)] + near
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, base[1]), (3, base[0]), (90, None), (91, [0.0] * 5), (92, [0.0] * 5), (93, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (None, base[0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    frame.coalesce(1).write.parquet(str(tmp_path / "rows"))
    (part,) = (tmp_path / "rows").glob("*.parquet")
    (tmp_path / "sf").mkdir()
    (tmp_path / "sf" / "embeddings.parquet").write_bytes(part.read_bytes())
    for name in ("i2_near_pairs", "i5_leakage_pairs"):
        assert compare(spark, str(tmp_path / "sf"), catalogue.queries()[name], catalogue.oracle_sql()[name]) > 100
    pair = spark.createDataFrame([(0, [1.0, 1.0, 0.0]), (1, [1.0, 0.0, 1.0])], "ord long, vector array<double>")
    assert [tuple(r) for r in N.near_pairs(pair, 0.5, every=True).select("i", "j").collect()] == [(0, 1)]
    assert N.near_pairs(pair.limit(0), 0.5, every=True).count() == 0


def test_merge_shards(spark, tmp_path):
    from quillmill.operators.near_rows import merge_shards

    text = lambda i: f"question number {i} about a matter of {i * 7919 % 1000} " * 3
    row = lambda i, t: json.dumps({"row_id": i, "component": "socratic", "messages": turns_of(("system", "s"), ("user", t), ("assistant", "yes, " + t))})
    for k in (0, 1):
        lines = [row(i, "".join(random.Random(i).choices("abcdefghijklmnop ", k=200))) for i in range(20 * k, 20 * k + 20)] + [row(100 + k, text(1)), row(200, text(2) + "!" * k), '{"row_id": 1, "mess', ""]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / f"s{k}"))
    got = {r.stage: r.n for r in merge_shards(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")], str(tmp_path / "out")).collect()}
    assert got["read"] == 44 and got["exact"] == 43 and got["near"] == 42 and got["train"] == 37 and got["eval"] == 5
    assert spark.read.json(str(tmp_path / "out")).groupBy("split").count().collect() and spark.read.json(str(tmp_path / "out/split=train")).count() == 37
    with pytest.raises(ValueError, match="no rows"):
        spark.createDataFrame([("",)], "value string").write.text(str(tmp_path / "none"))
        merge_shards(spark, [str(tmp_path / "none")], str(tmp_path / "out2"))


def test_embedding_batch_halves(spark):
    from quillmill.operators.near_rows import embed

    def small(texts):
        if len(texts) > 3:
            raise MemoryError
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(i, None if i == 4 else "x" * i) for i in range(40)], "id long, text string")
    assert {r.id: r.vector[0] for r in embed(rows, F.col("text"), small).collect()} == {i: 0 if i == 4 else i for i in range(40)}


CITED = [{"head": "المادة", "key": "1", "canonical": "المادة 1", "gloss": "l-madda 1"}, {"head": "المادة", "key": "12", "canonical": "المادة 12", "gloss": "l-madda 12"}, {"head": "القانون", "key": "42-25", "canonical": "القانون رقم 42.25", "gloss": "Loi N° 42.25"}, {"head": "Loi", "key": "9-08", "canonical": "Loi N° 9-08", "gloss": None}]


@pytest.mark.parametrize(("text", "script", "want"), [
    ("chouf l-madda 12 w madda 12.", "arabizi", "chouf المادة 12 (l-madda 12) w l-madda 12."),
    ("المادة 12 katgoul", "arabizi", "المادة 12 (l-madda 12) katgoul"),
    ("الماده 1 (l-madda 1) safi, article 1", "arabizi", "الماده 1 (l-madda 1) safi, l-madda 1"),
    ("article 99 makaynch", "arabizi", "article 99 makaynch"),
    ("Article 12 et loi 42-25", "french", "Article 12 et Loi N° 42.25"),
    ("al-madda 1 w 9anwn r9m 42-25", "arabic", "المادة 1 w القانون رقم 42.25"),
    ("qanoun 9.08", "arabizi", "Loi N° 9-08"),
    ("7sb l-madda 999 khass", "arabizi", "7sb l-madda 999 khass"),
    ("7sb المادة 12 mn al9anwn", "arabizi", "7sb المادة 12 (l-madda 12) mn al9anwn"),
    ("المادة 1 (l-madda 1) w المادة 12 kt7dd", "arabizi", "المادة 1 (l-madda 1) w المادة 12 (l-madda 12) kt7dd"),
    ("المادة 12 ... w 3awtani l-madda 12", "arabizi", "المادة 12 (l-madda 12) ... w 3awtani l-madda 12"),
    ("7sb l-madda 12 khass, المادة 12 w المادة 12", "arabizi", "7sb المادة 12 (l-madda 12) khass, المادة 12 (l-madda 12) w المادة 12"),
    ("7sb 9anwn 42-25 khass", "arabizi", "7sb القانون رقم 42.25 (Loi N° 42.25) khass"),
    ("al9anwn r9m 42.25 kynzm, qanoun 42-25", "arabizi", "القانون رقم 42.25 (Loi N° 42.25) kynzm, Loi N° 42.25"),
    ("القانون رقم 42.25 (Loi N° 42.25)", "arabizi", "القانون رقم 42.25 (Loi N° 42.25)"),
    ("7sb 9anwn 99-99", "arabizi", "7sb 9anwn 99-99"), ("المادة 1 (l-madda 1)", "french", "المادة 1 (l-madda 1)"), ("المادة 123 و المادة 1", "arabizi", "المادة 123 و المادة 1 (l-madda 1)"),
    ("chi text 3adi", "arabizi", "chi text 3adi"), ("", "french", ""), ("ARTICLE n° 12, Fasl 1", "french", "Article 12, Fasl 1"),
    (None, "arabic", None),
])
def test_inject_citations(spark, text, script, want):
    from quillmill.operators.citing import inject_citations

    frame = spark.createDataFrame([(1, text, script, CITED)], "id long, t string, s string, c array<struct<head: string, key: string, canonical: string, gloss: string>>")
    assert inject_citations(frame, F.col("c"), F.col("t"), F.col("s")).first().rewritten == want


def test_citations_and_gates_on_arabic(spark):
    from quillmill.functions import references as X
    from quillmill.operators.citing import extract_citations

    text = "المادةُ ٥ ثم الماده 5 و المرسوم رقم 2-12 و القانون رقم 27.06، Loi n° 27-06. ISO 9001 article 3"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["head"], r.key): r.canonical for r in extract_citations(frame).collect()}
    assert got == {("المادة", "5"): "المادة 5", ("المرسوم", "2-12"): "المرسوم 2-12", ("القانون", "27-06"): "القانون رقم 27.06", ("Loi", "27-06"): "Loi N° 27-06.", ("ISO", "9001"): "ISO 9001", ("Article", "3"): "Article 3"} or ("Loi", "27-06-") in got
    rows = spark.createDataFrame([(1, turns_of(("assistant", "حسب المادة 7 و القسم الأول و SEC-07, 48 ساعة")), "المادةُ ٧ فقط. القسم الاول 24 ساعة")], "row_id long, messages array<struct<role: string, content: string>>, context string")
    m, c = F.col("messages"), F.col("context")
    r = rows.select(X.ungrounded_references(m, c).alias("refs"), X.ungrounded_numbers(m, c).alias("numbers")).first()
    assert r.refs == ["SEC-07"] and r.numbers == ["48 ساعة"]
    assert rows.select(X.normalize_arabic(F.lit("اﻟﺒﻄﺎﻗﺔ ﬁn")).alias("n"), X.fold_arabic(F.lit("إلى المادة ٣")).alias("f")).first()[:] == ("البطاقة fin", "الي الماده 3")


def test_recover_and_salvage(spark):
    from quillmill.operators.recovery import recover_json, salvage

    given = {
        1: '{"a": [1, 2]}', 2: 'Text before\n```json\n[{"a": "x"}]\n```', 3: '{"a": "x".}', 4: '{"a": [1, 2,],}', 5: '{"a": "cut in the mid', 6: '{"a": [{"b": 1}, {"b"', 7: "no json", 8: None, 9: "", 10: '{"a": {"b": 1}} trailing words',
    }
    got = {r.id: r for r in recover_json(spark.createDataFrame(list(given.items()), "id long, response string")).collect()}
    value = lambda i: json.loads(got[i].json)
    assert {i: got[i].tier for i in got} == {1: "raw", 2: "raw", 3: "fixed", 4: "fixed", 5: "balanced", 6: None, 7: None, 8: None, 9: None, 10: "cut_fixed"}
    assert value(3) == {"a": "x"} and value(4) == {"a": [1, 2]} and value(5) == {"a": "cut in the mid"} and value(10) == {"a": {"b": 1}}
    bad = '{"messages": [{"role": "user", "content": "a \\"q\\" b"}, {"role": "assistant", "content": "line\\nbreak"} "messages": [{"content": "c", "role": "user"}'
    rows = salvage(spark.createDataFrame([(1, bad), (2, None), (3, "nothing")], "id long, response string")).orderBy("conversation").collect()
    assert [[(m.role, m.content) for m in r.messages] for r in rows] == [[("user", 'a "q" b'), ("assistant", "line\nbreak")], [("user", "c")]]


def test_facts_whole_needles_in_slices(spark):
    from quillmill.operators.evaluation import fact_coverage, fact_totals

    chunks = spark.createDataFrame([("abc and abc",), ("xabcd",), (None,), ("",)], "content string")
    needles = spark.createDataFrame([("a", "abc"), ("a", "abc"), ("b", "bcd"), ("c", "zz"), ("d", None), ("e", "")], "label string, needle string")
    for limit in (100, 1):
        got = fact_coverage(chunks, needles, limit)
        assert {(r.label, r.hits, r.stored) for r in got.collect()} == {("a", 2, True), ("b", 1, True), ("c", 0, False), ("d", 0, False), ("e", 0, False)}
    assert {(r.tier, r.n, r.stored) for r in fact_totals(got, F.when(F.col("label") < "c", "basic").otherwise("more")).collect()} == {("basic", 2, 2), ("more", 3, 0), ("all", 5, 2)}


def sessions(spark):
    from quillmill.plans.registered_citing import _segment_turns

    return _segment_turns(spark, "/root/testdata/sf0.001")


def test_segments_follow_the_rules(spark):
    from quillmill.streaming.sessions import resolve_segments

    base = {"session_id": 1, "query_lang": "fr", "requested_domain": None, "routed_domain": "law", "routed_source": "retrieval", "corpus_version": "v", "probe_sources": ["s"], "content": "quelle est la règle sur les congés"}
    turns = [
        {"turn_index": 0, "probe_context": "A", "want": (1, True, "A", "retrieval")}, {"turn_index": 1, "content": "pourquoi ?", "probe_context": "B", "probe_sources": ["t"], "want": (1, False, "A", "pinned")},
        {"turn_index": 2, "probe_context": "B", "probe_sources": ["s", "t"], "want": (1, False, "A", "retrieval")}, {"turn_index": 3, "probe_context": "B", "probe_sources": ["t"], "want": (2, True, "B", "retrieval")},
        {"turn_index": 4, "probe_context": " ", "probe_sources": [], "want": (2, False, "B", "retrieval")}, {"turn_index": 5, "routed_domain": "tax", "probe_context": "", "probe_sources": [], "want": (2, False, "B", "pinned")},
        {"turn_index": 6, "query_lang": "darija", "probe_context": "C", "want": (3, True, "C", "retrieval")}, {"turn_index": 7, "query_lang": "darija", "corpus_version": "w", "content": "et ?", "probe_context": "D", "want": (4, True, "D", "retrieval")},
        {"turn_index": 8, "query_lang": "darija", "corpus_version": None, "content": "et ?", "requested_domain": "law", "probe_context": "E", "want": (4, False, "D", "page_context")},
    ]
    rows = [{k: v for k, v in (base | t).items() if k != "want"} for t in turns]
    frame = spark.createDataFrame([tuple(r[k] for k in sorted(base | turns[0]) if k != "want") for r in rows], ", ".join(f"{k} {'array<string>' if k == 'probe_sources' else 'long' if k in ('session_id', 'turn_index') else 'string'}" for k in sorted(base | turns[0]) if k != "want"))
    got = {r.turn_index: (r.segment_id, r.is_new_pin, r.context, r.domain_source) for r in resolve_segments(frame).collect()}
    assert got == {t["turn_index"]: t["want"] for t in turns}


def run_stream(spark, query, name, path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = query.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name)


def test_session_stream_equals_batch(spark, tmp_path):
    from quillmill.streaming.sessions import resolve_segments, resolve_segments_stream

    turns = sessions(spark)
    for i, part in enumerate((turns.where("turn_index < 4"), turns.where("turn_index >= 4"))):  # two triggers
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda df: sorted((r.session_id, r.turn_index, r.context, tuple(r.sources), r.segment_id, r.is_new_pin, r.domain, r.domain_source) for r in df.collect())
    assert key(run_stream(spark, resolve_segments_stream(stream), "segments", tmp_path / "ck")) == key(resolve_segments(turns))


def test_endpoint_stream_equals_batch(spark, tmp_path):
    from quillmill.operators.evaluation import endpoints
    from quillmill.streaming.sessions import endpoints_stream

    rng = random.Random(2)
    frames = spark.createDataFrame([(s, i, None if rng.random() < 0.02 else 20.0 * (rng.random() < 0.6 + 0.3 * (i // 7 % 2))) for s in range(4) for i in range(200)], "stream_id long, frame_no long, level double")
    for lo in (0, 90):
        frames.where(f"frame_no >= {lo} AND frame_no < {lo + 90 + lo * 2}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(endpoints(frames, 10.0, 3, 2))
    assert want and key(run_stream(spark, endpoints_stream(stream, 10.0, 3, 2), "endpoints", tmp_path / "ck")) == want


def test_ingest_stream_is_idempotent(spark, tmp_path):
    from quillmill.streaming.ingest import ingest_batch, ingest_stream

    text = lambda i: "\n\n".join(f"# Part {k}\n\nWords of file {i} in part {k}. " + "More of them follow here. " * 40 for k in range(4))
    files = [("t1", "a", text(1)), ("t1", "b", text(2)), ("t2", "a", text(1)), ("t1", "c", text(1)), ("t1", "d", None)]
    schema = "tenant_id string, source_id string, content string"
    for i, part in enumerate((files[:3], files[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_stream(stream, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    read = lambda what: spark.read.parquet(str(tmp_path / "table" / what))
    status = {(r.tenant_id, r.source_id): (r.status, r.duplicate_of) for r in read("files").collect()}
    assert status == {("t1", "a"): ("ready", None), ("t1", "b"): ("ready", None), ("t2", "a"): ("ready", None), ("t1", "c"): ("duplicate", "a"), ("t1", "d"): ("error", None)}
    count = read("chunks").count()
    assert count and read("chunks").where("vector IS NULL").count() == 0 and read("chunks").where("source_id IN ('c', 'd')").count() == 0
    ingest_batch(spark.createDataFrame(files[3:], schema), 1, str(tmp_path / "table"))  # the batch comes again
    assert read("chunks").count() == count and read("files").count() == 5


def test_edit_distance_of_long_texts():
    """Exact on random strings by every way it is found, and long texts do not take a step for every pair of places."""
    import random
    import time

    from quillmill.operators.evaluation import _bit_edits, _numbered, edit_distance

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    for t in range(300):
        letters = ("ab", "aé漢😀", "abcdefgh")[t % 3]
        a = [rng.choice(letters) for _ in range(rng.randrange(150))]
        b = [c for c in a if rng.random() < 0.9] if t % 2 else [rng.choice(letters) for _ in range(rng.randrange(60))]
        want = plain(a, b)
        assert edit_distance(a, b) == edit_distance("".join(a), "".join(b)) == want
        if a and b:
            assert _bit_edits(*_numbered(a, b)) == want
    long = "".join(rng.choice("abcdefgh ") for _ in range(120_000))
    began = time.monotonic()
    assert 0 < edit_distance(long, "".join(c for i, c in enumerate(long) if i % 500)) <= 240
    assert edit_distance("ab" * 20_000, "ba" * 20_000) == 2
    assert time.monotonic() - began < 15


def test_composition_by_pieces(spark):
    """The pieces that reach Python give the composition of the whole text, wherever marks and compatibility forms stand."""
    import random
    import unicodedata

    from pyspark.sql import functions as F

    from quillmill.functions.references import INVISIBLE, normalize_arabic

    rng = random.Random(7)
    letters = [*"aé<= ئا\n", "e\u0301", "\u0627\u0653", "\ufefb", "ﬁ", "\u0338", "\u0651\u064e", "\u1112\u1161\u11ab", "😀", "²", "\u00a0", "\u0323", "が", "か\u3099"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", None, "plain", "\u0301"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    drop = dict.fromkeys([*range(0x64B, 0x656), *range(0x200B, 0x2010), 0x640, 0x670, 0x61C])
    got = {r.id: r.t for r in rows.select("id", normalize_arabic(F.col("text")).alias("t")).collect()}
    assert INVISIBLE and [got[i] for i in range(len(texts))] == [unicodedata.normalize("NFKC", t or "").translate(drop) for t in texts]


def test_facts_by_source_is_linear_in_needles(spark):
    """Windows of any length and script are found, in their own source alone, in slices too; the chunks meet hashes, not lists of needles."""
    from quillmill.operators.evaluation import facts_by_source

    chunks = [("s", "abcabc é漢😀!"), ("s", "abc"), ("t", "abc"), (None, "abc"), ("s", None), ("s", ""), ("u", "x" * 5000 + "end")]
    needles = [(1, "abc", "s"), (1, "abc", "s"), (2, "abc", "s"), (1, "漢😀", "s"), (1, "", "s"), (1, None, "s"), (1, "abc", None), (1, "nope", "t"), (1, "x" * 4999 + "xend", "u"), (1, "c", "t"), (1, "bca", "t")]
    c, n = spark.createDataFrame(chunks, "source string, content string"), spark.createDataFrame(needles, "label int, needle string, source string")
    want = {(1, "abc", "s"): 2, (2, "abc", "s"): 2, (1, "漢😀", "s"): 1, (1, "", "s"): 0, (1, None, "s"): 0, (1, "abc", None): 0, (1, "nope", "t"): 0, (1, "x" * 5000 + "end", "u"): 1, (1, "c", "t"): 1, (1, "bca", "t"): 0}
    for most in (1 << 20, 3):
        got = facts_by_source(c, n, most)
        assert {(r.label, r.needle, r.source): r.hits for r in got.collect()} == want and all(r.stored == (r.hits > 0) for r in got.collect())
    plan = got._jdf.queryExecution().toString()
    assert "collect_set" not in plan
    assert facts_by_source(c.limit(0), n).where("stored").count() == 0 and facts_by_source(c, n.limit(0)).count() == 0


def test_script_spans_shuffle_nothing(spark):
    from quillmill.operators.chunking import script_spans

    texts = [(1, " ... a1 x 2\n! 3 y"), (2, "- -"), (3, None), (4, ""), (5, "word " * 30_000 + "7"), (5, "one 1")]
    got = script_spans(spark.createDataFrame(texts, "doc_id long, text string"), "[0-9]", "[A-Za-z]", ("number", "word"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    rows = sorted((r.doc_id, r.span_no, r.lang, len(r.text) if r.doc_id == 5 else r.text) for r in got.collect())
    assert rows == [(1, 0, "number", "... a1"), (1, 1, "word", "x"), (1, 2, "number", "2 ! 3"), (1, 3, "word", "y"), (2, 0, "word", "- -"), (5, 0, "word", 3), (5, 0, "word", 149_999), (5, 1, "number", 1), (5, 1, "number", 1)]


def test_near_rows_are_sent_in_bounded_slices(spark):
    """Whole cells share a slice up to its size, a larger cell is cut in parts, every cell is in some slice."""
    from quillmill.operators import near_rows as N

    cells = spark.createDataFrame([(c,) for c, n in ((0, 3), (1, 4), (2, 25), (3, 5), (5, 5), (6, 1)) for _ in range(n)], "cell int")
    assert N._slices(cells, 10) == [(0, 1, 0, 1), (2, 2, 0, 3), (2, 2, 1, 3), (2, 2, 2, 3), (3, 5, 0, 1), (6, 6, 0, 1)]


def test_shapes_behind_their_first_letter_find_the_same(spark):
    """A shape searched behind a test of its first letter finds what its own pattern finds, in either case, with a long s and in every spelling."""
    from quillmill.functions import references as X

    rng = random.Random(9)
    words = ["Section", "ſection", "SECTION", "section", "loi n°", "LOI N°", "Loi", "ISO", "iso", "article", "Article", "chapter", "CHAPITRE", "annexe", "Annex", "décret", "Decret n°", "EN", "P.", "p.", "paragraph", "المادة", "ٱلمادّه", "القانون رقم", "صفحه", "الي", "xArticle", "é"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n"]) + rng.choice(["12", "٣", "4-1", "45001", "", "x"]) + rng.choice([" ", "", ";"]) for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for s in X.SHAPES:
        own = ("(?iU)" if s.pattern.startswith("(?i)") else "(?U)") + s.pattern.removeprefix("(?i)")
        same = F.regexp_extract_all("t", F.lit(X.searched(s)), F.lit(1)) == F.regexp_extract_all("t", F.lit(own), F.lit(1))
        assert rows.where(~same).count() == 0, s.head


def test_stable_letters_stay_out_of_python(spark):
    """What composition leaves alone is neither sent to Python nor cut at; what follows it may still join it."""
    import re
    import unicodedata

    from quillmill.functions import references as X

    stable = [chr(c) for c in range(0x80, 0x10000) if re.match(f"[{X.STABLE}]", chr(c))]
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    joining = {x for c in range(0x10000) for x in unicodedata.normalize("NFD", chr(c))[1:]}
    assert not joining & set(stable)
    texts = ["".join(stable), "L'été — « المادة ٣ ؟ »", "", "اٴ", "آب", "ẹ́" + "".join(stable) + "́", "ﻻا" * 9, "😀".join(stable[:50])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sent = F.when(F.col("t").rlike(X._CHANGING), F.regexp_extract_all("t", F.lit(X.COMPOSED), F.lit(0)))
    got = {r.id: r for r in rows.select("id", sent.alias("sent"), X.normalize_arabic(F.col("t")).alias("n")).collect()}
    assert [got[i].sent for i in range(3)] == [None] * 3
    assert got[4].sent == ["آ"] and got[5].sent == ["ẹ́", stable[-1] + "́"]
    marks = dict.fromkeys([*range(0x64B, 0x656), *range(0x200B, 0x2010), 0x640, 0x670, 0x61C])
    assert [got[i].n for i in range(len(texts))] == [unicodedata.normalize("NFKC", t).translate(marks) for t in texts]


def test_dropped_items_need_no_table_of_edits(monkeypatch):
    """Where one side is the other with items left out, the distance is the difference of the lengths, without any search."""
    from quillmill.operators import evaluation as V

    rng = random.Random(8)
    pairs = [("", ""), ("", "ab"), ("é😀", "é😀"), ("the cat sat".split(), "cat sat".split())]
    for n in (1, 5, 400):
        text = "".join(rng.choice("abc é") for _ in range(n))
        pairs.append((text, "".join(c for c in text if rng.random() < 0.8)))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, v in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, w in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (v != w))
        return row[-1]

    other = [("abcd", "acbd"), ("aab", "ba"), ("ab", "ba"), ("abc" * 30, "x"), ("ab" * 40, "b" + "a" * 300), (["a", "b"], ["b", "c", "a"])]
    assert all(V.edit_distance(a, b) == V.edit_distance(b, a) == plain(a, b) for a, b in pairs + other)
    x, y = V._numbered("ab" * 40, "b" + "a" * 300)
    assert V._few_edits(x, y, 219) is None
    monkeypatch.setattr(V, "_few_edits", None)
    monkeypatch.setattr(V, "_bit_edits", None)
    assert all(V.edit_distance(a, b) == V.edit_distance(b, a) == abs(len(a) - len(b)) for a, b in pairs)
    long = "de la " * 20_000
    assert V.edit_distance(long, long.replace("la ", "")) == 60_000


def test_citations_come_from_one_scan(spark):
    """One scan for all shapes finds what a scan for each finds, in the same order, also where references touch, nest in words or stand behind other heads."""
    from quillmill.functions import references as X

    rng = random.Random(10)
    heads = ["Section", "ſection", "SECTıON", "secTİon", "loi n°", "emploi n", "LOI No", "Loi", "ISO", "MISO", "iso", "article", "Article", "l'article", "chapter", "CHAPITRE", "annexe", "ANNEX", "décret", "DÉCRET n°", "Decret", "EN", "SECTIEN", "P.", "p.", "xp.", "Paragraph", "paragraphe"]
    heads += [s.head for s in X.ARABIC_SHAPES] + ["ٱلمادّه", "الفَصل", "القانون رقم", "القانون رَقم", "المرسوم رقم", "القرار رقم", "وصفحه", "صـفحة", "الي", "|", "é"]
    pick = lambda *x: rng.choice(x)
    texts = ["".join(rng.choice(heads) + pick(" ", " ", " ", "", "\n", " ", " n ") + pick("12", "٣", "4-1", "27.05", "450011", "16", "-", ".", "", "x", "5a", "5.") + pick(" ", "", ";", "|", "\n") for _ in range(12)) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (-2, "")], "id long, t string")
    each = F.concat(*[X._entries(F.coalesce("t", F.lit("")), i, s) for i, s in enumerate(X.SHAPES)])
    got = rows.select("id", X.citations_of(F.col("t")).alias("one"), each.alias("each")).collect()
    assert all(r.one == r.each for r in got) and {c.shape for r in got for c in r.one} == set(range(len(X.SHAPES)))
    calls = X.citations_of(F.col("whole"))._jc.toString().count("coalesce(whole")
    assert calls == 1
