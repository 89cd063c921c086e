"""Batch retrieval: filtered cosine top-k, language affinity, domain vote and resolution, refusal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import chunk_documents
from .context import BUDGET, assemble_context
from .near_rows import embed, hashed_ngrams

MAX_QUERIES, QUERY_BLOCK, CHUNK_BLOCK = 20_000, 1000, 2000


def _unit(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which of them are vectors at all (null ones and those of another width are not)."""
    fine = np.array([v is not None and len(v) == width and None not in v for v in vectors], bool)
    m = np.zeros((len(vectors), width))
    if fine.any():
        m[fine] = np.array([v for v, ok in zip(vectors, fine, strict=True) if ok], np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return m, fine


class _Best:
    """The k best chunks of each query so far: parallel arrays, cut back after every block. Ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.query, self.sim, self.ids, self.domains = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0, object)

    def add(self, query: np.ndarray, sim: np.ndarray, ids: np.ndarray, domains: np.ndarray) -> None:
        q, s, i, d = (np.concatenate(p) for p in ((self.query, query), (self.sim, sim), (self.ids, ids), (self.domains, domains)))
        order = np.lexsort((np.array(i.tolist()), -s, q)) if len(q) else np.zeros(0, np.int64)
        q = q[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, np.int64)
        order = order[place < self.k]
        self.query, self.sim, self.ids, self.domains = q[place < self.k], s[order], i[order], d[order]


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, chunk_id, domain, similarity, rank): the k nearest chunks of each query by cosine, ties by id.

    queries: (query_id, vector, domain) and, if they have them, tenant_id and sources; chunks: (chunk_id, vector, domain,
    source_file_id) and tenant_id if the queries have it. A query's domain admits its own chunks and those of uploaded
    sources, null admits all; its sources (an array) admit those uploads and all chunks of no upload, null admits all; a
    tenant sees its own chunks alone. A chunk never answers the query of its own id. Filters apply before the limit; ids
    are of any one type; null vectors neither ask nor answer. A block of queries is sent to the chunks (its size is
    checked, more go in further blocks), and every task keeps a running best k of each query, so no pair is ever a row.
    """
    spark = chunks.sparkSession
    out = None
    has_tenant, has_sources = "tenant_id" in queries.columns, "sources" in queries.columns
    wanted_columns = ["query_id", "vector", "domain", *(["tenant_id"] if has_tenant else []), *(["sources"] if has_sources else [])]
    numbered = queries.select(*wanted_columns).where("vector IS NOT NULL")
    q_kind, c_kind, d_kind = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString(), chunks.schema["domain"].dataType.simpleString()
    schema = f"query_id {q_kind}, chunk_id {c_kind}, domain {d_kind}, similarity double"
    total = numbered.count()
    blocks = max(1, -(-total // max_queries))
    for block in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else numbered
        rows = part.collect()  # one block of the stated query set, bounded by its count
        if not rows:
            continue
        width = len(rows[0].vector)
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], object), *_unit([r.vector for r in rows], width), np.array([r.domain for r in rows], object), np.array([r.tenant_id for r in rows], object) if has_tenant else None, [r.sources for r in rows] if has_sources else None))

        def search(batches, sent=sent, width=width):
            ids, wanted, asks, domains, tenants, sources = sent.value
            best = _Best(k)
            for b in batches:
                for lo in range(0, b.num_rows, CHUNK_BLOCK):
                    c = b.slice(lo, CHUNK_BLOCK)
                    own, has, upload = (np.array(c.column(i).to_pylist(), object) for i in (0, 2, 3))
                    m, answers = _unit(c.column(1).to_pylist(), width)
                    theirs = np.array(c.column(4).to_pylist(), object) if has_tenant else None
                    for at in range(0, len(ids), QUERY_BLOCK):
                        q = slice(at, at + QUERY_BLOCK)
                        sims = wanted[q] @ m.T
                        ok = asks[q, None] & answers & (ids[q, None] != own)
                        ok &= np.equal(domains[q, None], None) | (domains[q, None] == has) | ~np.equal(upload, None)
                        if has_tenant:
                            ok &= tenants[q, None] == theirs
                        if has_sources:
                            for i, some in enumerate(sources[q]):
                                if some is not None:
                                    ok[i] &= np.equal(upload, None) | np.isin(upload.astype(str), [str(x) for x in some])
                        sims[~ok] = -np.inf
                        if len(own) > k:  # nothing below a row's k-th best can be among its k best
                            floor = np.partition(sims, len(own) - k, axis=1)[:, len(own) - k]
                            ok &= sims >= floor[:, None]
                        rows_, cols = np.nonzero(ok)
                        best.add(rows_ + at, sims[rows_, cols], own[cols], has[cols])
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.query], fields[0]), pa.array(best.ids.tolist(), fields[1]), pa.array(best.domains.tolist(), fields[2]), pa.array(best.sim, pa.float64())], ["query_id", "chunk_id", "domain", "similarity"])

        from pyspark.sql.pandas.types import to_arrow_type

        fields = [to_arrow_type(f.dataType) for f in (queries.schema["query_id"], chunks.schema["chunk_id"], chunks.schema["domain"])]
        near = chunks.select("chunk_id", "vector", "domain", "source_file_id", *(["tenant_id"] if has_tenant else [])).mapInArrow(search, schema)
        out = near if out is None else out.union(near)
    if out is None:
        out = spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def select_affinity(cands: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """First k candidates of a query, all of its target language if it has k of them, else the first k of any and
    cross_language where one differs. cands: (query_id, rank, similarity, language, target_language); target null: off."""
    if threshold is not None:
        cands = cands.where(F.col("similarity") >= threshold)
    same = F.coalesce(F.col("language") == F.col("target_language"), F.lit(False))
    by = Window.partitionBy("query_id")
    ranked = cands.withColumn("same", same).withColumn("n_same", F.sum(F.col("same").cast("int")).over(by))
    ranked = ranked.withColumn("place", F.row_number().over(by.orderBy(F.when((F.col("n_same") >= k) & ~F.col("same"), 1).otherwise(0), "rank")))
    kept = ranked.where(F.col("place") <= k)
    return kept.withColumn("cross_language", F.coalesce(F.max(F.col("target_language").isNotNull() & ~F.col("same")).over(by), F.lit(False))).drop("same", "n_same")


def vote_domain(cands: DataFrame, threshold: float = 0.4, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(query_id, domain): the domain of greatest summed similarity at or above threshold; ties go to the better rank."""
    sums = cands.where((F.col("similarity") >= threshold) & F.col("domain").isNotNull()).groupBy(*by, "domain").agg(F.sum("similarity").alias("votes"), F.min("rank").alias("best"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "best"))
    return sums.withColumn("place", first).where("place = 1").select(*by, "domain")


def threshold_sweep(cands: DataFrame, queries: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, n, n_voted, n_right) of candidates (query_id, domain, similarity, rank) and queries (query_id, gold): how many
    queries get a vote at each threshold, and how many of them the right one."""
    sweep = F.array(*[F.lit(float(t)) for t in thresholds])
    votes = vote_domain(cands.withColumn("threshold", F.explode(sweep)).where("similarity >= threshold"), float("-inf"), ("threshold", "query_id"))
    every = queries.withColumn("threshold", F.explode(sweep)).join(votes.select("threshold", "query_id", F.col("domain").alias("voted")), ["threshold", "query_id"], "left")
    return every.groupBy("threshold").agg(F.count("*").alias("n"), F.count("voted").alias("n_voted"), F.count_if(F.col("voted") == F.col("gold")).alias("n_right"))


def resolve_domain(queries: DataFrame, votes: DataFrame, default, indexed: bool = True) -> DataFrame:
    """(query_id, domain, domain_source): an explicit domain is page_context, else the vote, else the default (no_match).
    Without an index there is no vote: what is not explicit takes the default (tenant_default)."""
    if not indexed:
        explicit = F.col("domain").isNotNull()
        return queries.select("query_id", F.coalesce("domain", F.lit(default)).alias("domain"), F.when(explicit, "page_context").otherwise("tenant_default").alias("domain_source"))
    voted = queries.select("query_id", F.col("domain").alias("explicit")).join(votes.select("query_id", F.col("domain").alias("voted")), "query_id", "left")
    source = F.when(F.col("explicit").isNotNull(), "page_context").when(F.col("voted").isNotNull(), "retrieval").otherwise("no_match")
    return voted.select("query_id", F.coalesce("explicit", "voted", F.lit(default)).alias("domain"), source.alias("domain_source"))


def refusal(resolved: DataFrame) -> DataFrame:
    """Adds refused and trigger: no domain matched, the context is blank, both, or none. Needs domain_source, context_chars."""
    missed, empty = F.col("domain_source") == "no_match", F.coalesce(F.col("context_chars"), F.lit(0)) == 0
    trigger = F.when(missed & empty, "both").when(missed, "no_match_only").when(empty, "empty_only").otherwise("none")
    return resolved.withColumn("refused", missed | empty).withColumn("trigger", trigger)


def score_retrieval(cands: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """One row: n, recall@k and MRR of the first candidate that has the query's gold label. Needs rank and is_gold."""
    first = cands.where("is_gold").groupBy("query_id").agg(F.min("rank").alias("first"))
    joined = queries.select("query_id").join(first, "query_id", "left")
    n = F.greatest(F.count("*"), F.lit(1))
    return joined.agg(F.count("*").alias("n"), (F.count(F.when(F.col("first") <= k, 1)) / n).alias("recall"), (F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))) / n).alias("mrr"))


def retrieval_rates(results: DataFrame) -> DataFrame:
    """One row from (gold_substring, context, top_script, query_lang, has_gold): the share of rows with a gold substring whose
    context holds it, the share whose best source is in another script than the query (Arabizi asks Arabic sources and
    counts as the same), and the share of rows without gold whose context is empty; denominators of at least 1."""
    rate = lambda hit, among: F.count_if(F.coalesce(hit & among, F.lit(False))) / F.greatest(F.count_if(F.coalesce(among, F.lit(False))), F.lit(1))
    context = F.coalesce("context", F.lit(""))
    other = ~F.coalesce((F.col("top_script") == F.col("query_lang")) | ((F.col("top_script") == "ar") & (F.col("query_lang") == "darija")), F.lit(True))
    return results.agg(
        rate(F.contains(context, F.col("gold_substring")), F.col("gold_substring").isNotNull()).alias("substring_rate"), rate(other, F.col("top_script").isNotNull()).alias("cross_language_rate"),
        rate(F.trim(context) == "", ~F.col("has_gold")).alias("empty_context_rate"),
    )


def retrieval_misses(cands: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """(query_id) of the queries none of whose first k candidates is gold."""
    hit = cands.where(F.col("is_gold") & (F.col("rank") <= k)).select("query_id")
    return queries.select("query_id").join(hit, "query_id", "left_anti")


def vote_upload_domain(probes: DataFrame, chunks: DataFrame, default, k: int = 10, threshold: float = 0.4) -> DataFrame:
    """(query_id, domain, domain_source) for uploads: each probe (query_id, vector of the first chunk's head) asks its k
    nearest chunks of any domain; without a vote the default stands."""
    domain_type = chunks.schema["domain"].dataType
    free = probes.select("query_id", "vector", F.lit(None).cast(domain_type).alias("domain"))
    votes = vote_domain(top_k(free, chunks, k), threshold)
    return resolve_domain(free, votes, default)


INDEXED, LOCAL, INDEXED_THRESHOLD, PROBE_CHARS = "indexed", "local", 0.4, 500


def retrieve(queries: DataFrame, chunks: DataFrame, backend: str, k: int = 4, threshold: float | None = None, budget: int = BUDGET) -> DataFrame:
    """(query_id, context, sources, cross_language, fingerprint) for each query.

    queries: (query_id, text, vector, domain, ui_lang, target_language) and, if they have them, tenant_id and sources; chunks:
    (chunk_id, vector, domain, source_file_id, content, source, language) and tenant_id if the queries have it. The indexed
    backend searches all chunks a query may see and drops what is below the threshold (0.4 unless given); the local one
    searches the query's own domain without uploads or a source list, and has no threshold unless one is given; any other
    is an error. Of max(4 k, 20) candidates k are selected by language affinity, put together within the budget, and met
    with their texts only then. A query without candidates has an empty context; the fingerprint is of domain, ui_lang and
    text, a null one written as None.
    """
    if backend not in (INDEXED, LOCAL):
        raise ValueError(f"unknown retrieval backend {backend!r}")
    if backend == LOCAL:
        chunks, queries = chunks.where("source_file_id IS NULL"), queries.drop("sources")
    elif threshold is None:
        threshold = INDEXED_THRESHOLD
    near = top_k(queries, chunks, max(4 * k, 20))
    told = near.select("query_id", "chunk_id", "similarity", "rank").join(chunks.select("chunk_id", "language"), "chunk_id").join(queries.select("query_id", "target_language"), "query_id")
    chosen = select_affinity(told, k, threshold).select("query_id", "chunk_id", "place", "cross_language")
    parts = chosen.join(chunks.select("chunk_id", "content", "source"), "chunk_id")
    contexts = assemble_context(parts, budget)
    crossed = chosen.groupBy("query_id").agg(F.bool_or("cross_language").alias("cross_language"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    asked = queries.select("query_id", F.sha2(F.concat_ws("|", named("domain"), named("ui_lang"), named("text")), 256).alias("fingerprint"))
    out = asked.join(contexts, "query_id", "left").join(crossed, "query_id", "left")
    return out.select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("cross_language", F.lit(False)).alias("cross_language"), "fingerprint")


def vote_upload_files(files: DataFrame, chunks: DataFrame, default, encoder: Callable[[list[str]], np.ndarray] = hashed_ngrams, k: int = 10, threshold: float = 0.4) -> DataFrame:
    """vote_upload_domain() for uploaded files (query_id, text): the first 500 characters of a file's first chunk are encoded and
    ask. A file without any chunk takes the default (no_match)."""
    first = chunk_documents(files, id_col="query_id").where("chunk_index = 0").select("query_id", F.substring("content", 1, PROBE_CHARS).alias("_probe"))
    probes = embed(first, F.col("_probe"), encoder).select("query_id", "vector")
    domain_type = chunks.schema["domain"].dataType
    votes = vote_domain(top_k(probes.withColumn("domain", F.lit(None).cast(domain_type)), chunks, k), threshold)
    return resolve_domain(files.select("query_id", F.lit(None).cast(domain_type).alias("domain")), votes, default)
