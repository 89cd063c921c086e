"""The list of generation attempts: domain, turns and source document of each drawn by seeded hashes, in joins alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_chars
from ..sources.files import settle

# Which components are about a document, prefer Arabic ones, mix scripts or have no context; the shares.
GROUNDED = ("socratic", "code_switching", "grounded_refusal", "quiz_generation", "injection_resistance", "structured_explanation", "learner_adaptation")
EMPTY_CONTEXT = ("no_context_refusal", "general_knowledge_disclosed")
ARABIC_SOURCE = ("grounded_refusal", "quiz_generation")
FRENCH_CROSS_LINGUAL = ("socratic", "structured_explanation")
CROSS_LINGUAL_RATE, GENERALIZATION_SHARE, GENERALIZATION, ALIASES = 0.2, 0.2, "generalization", {"securite": "securite_physique"}
PLACEHOLDER, GENERIC, MAX_CONTEXT = "No context available.", "General enterprise knowledge.", 1200
CHUNK = 10_000  # attempts that one array holds while a target is spread out


def draw(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of seed and parts, the same on every run and for every partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def is_arabic_document(content: Column) -> Column:
    text = F.coalesce(content, F.lit(""))
    return count_chars(text, "ء-ي") > count_chars(text, "A-Za-z") * 0.15


def number_pools(corpus: DataFrame) -> DataFrame:
    """(domain, arabic, place, path, content): the documents of each domain and script, numbered from 0 in the order of the md5
    of their path. Counts of the first digits are summed, so a pool is sorted in 4,096 parts however large it is."""
    key = F.md5(F.coalesce(F.col("path"), F.lit("")))
    rows = corpus.select("domain", is_arabic_document(F.col("content")).alias("arabic"), "path", F.substring(F.coalesce(F.col("content"), F.lit("")), 1, MAX_CONTEXT).alias("content"), key.alias("key"), F.substring(key, 1, 3).alias("head"))
    rows = settle(rows, "pools")
    heads = rows.groupBy("domain", "arabic", "head").agg(F.count("*").alias("n"))
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("domain", "arabic").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("domain", "arabic", "head").orderBy("key", "path", "content")) - 1
    numbered = rows.withColumn("inner", place).join(heads.select("domain", "arabic", "head", lower.alias("lower")), ["domain", "arabic", "head"])
    return numbered.select("domain", "arabic", (F.col("lower") + F.col("inner")).alias("place"), "path", "content")


def domains_by_scope(corpus: DataFrame) -> DataFrame:
    """(domain, general, place, size): the known domains in order within their kind. A domain is general when all its documents
    lie in the generalization scope. One row a domain."""
    kinds = corpus.where("domain <> 'unknown'").groupBy("domain").agg(F.bool_and(F.coalesce(F.col("scope"), F.lit("")) == GENERALIZATION).alias("general"))
    order = Window.partitionBy("general").orderBy("domain")
    return kinds.select("domain", "general", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(Window.partitionBy("general")).alias("size"))


def plan_generation(targets: DataFrame, corpus: DataFrame, seed: int = 42, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """(component, attempt, language, domain, multi_turn, path, context) for every attempt of targets (component, attempts,
    language, multi_turn_pct) over corpus (path, scope, domain, content).

    Where there are domains of both kinds, one attempt in five is about a general one; within its kind a domain is drawn
    evenly. A grounded component draws a document of its domain: French rows take Latin ones, but some components one in
    five Arabic; refusals half and half; citing components Arabic first, others Latin first; a domain without the wanted
    script gives the other, one without documents a placeholder. The context is the document's beginning, empty, or generic.
    All draws are hashes of seed, component and attempt. Attempts meet documents by (domain, script, place), so nothing but
    the domains' sizes is ever small data; no domain at all gives no attempts.
    """
    spread = targets.where("attempts > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("attempts") - 1) / CHUNK))))
    spread = spread.withColumn("attempt", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("attempts")) - 1)))
    u = lambda what: draw(seed, F.col("component"), F.col("attempt"), what)
    jobs = spread.select("component", "attempt", F.coalesce("language", F.lit("darija")).alias("language"), (u("turns") < F.coalesce("multi_turn_pct", F.lit(0.0))).alias("multi_turn"), u("kind").alias("u_kind"), u("domain").alias("u_domain"), u("script").alias("u_script"), u("document").alias("u_document"))
    known = settle(domains_by_scope(corpus), "domains")
    kinds = known.agg(F.coalesce(F.max(F.when(F.col("general"), F.col("size"))), F.lit(0)).alias("n_general"), F.coalesce(F.max(F.when(~F.col("general"), F.col("size"))), F.lit(0)).alias("n_client")).first()
    general = F.lit(kinds.n_client == 0) if 0 in (kinds.n_client, kinds.n_general) else F.col("u_kind") < GENERALIZATION_SHARE
    size = F.when(F.col("general"), F.lit(kinds.n_general)).otherwise(F.lit(kinds.n_client))
    placed = jobs.withColumn("general", general).withColumn("place", F.floor(F.col("u_domain") * size).cast("int"))
    about = placed.join(known.select("general", "place", "domain"), ["general", "place"]).drop("general", "place")
    folder = F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.col("domain")], F.col("domain")) if aliases else F.col("domain")
    pools = settle(number_pools(corpus), "numbered")
    sizes = pools.groupBy(F.col("domain").alias("folder")).agg(F.count_if("arabic").alias("n_arabic"), F.count_if(~F.col("arabic")).alias("n_latin"))
    jobs = about.withColumn("folder", folder).join(sizes, "folder", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_arabic", "n_latin")})
    component, french = F.col("component"), F.col("language") == "fr"
    both = (F.col("n_arabic") > 0) & (F.col("n_latin") > 0)
    wanted = (
        F.when(french & component.isin(*FRENCH_CROSS_LINGUAL) & both, F.col("u_script") < CROSS_LINGUAL_RATE).when(french, False)
        .when((component == "grounded_refusal") & both, F.col("u_script") < 0.5).otherwise(component.isin(*ARABIC_SOURCE))
    )
    arabic = F.when(wanted, F.col("n_arabic") > 0).otherwise(F.col("n_latin") == 0)
    jobs = jobs.withColumn("arabic", arabic).withColumn("place", F.when(component.isin(*GROUNDED), F.floor(F.col("u_document") * F.when(F.col("arabic"), F.col("n_arabic")).otherwise(F.col("n_latin")))))
    met = jobs.join(pools.withColumnRenamed("domain", "folder"), ["folder", "arabic", "place"], "left")
    context = F.when(component.isin(*GROUNDED), F.regexp_replace(F.coalesce("content", F.lit(PLACEHOLDER)), r"(?U)^\s+|\s+$", "")).when(component.isin(*EMPTY_CONTEXT), "").otherwise(GENERIC)
    return met.select("component", "attempt", "language", "domain", "multi_turn", "path", context.alias("context"))
