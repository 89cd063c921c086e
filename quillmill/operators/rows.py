"""Training rows: messages, validity, gates, dedup, splits, planning and reports.

A row is (row_id, messages): messages is array<struct<role, content>> in turn order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CJK = r"\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF"


def rows_from_turns(turns: DataFrame) -> DataFrame:
    """(row_id, messages) from (conv_id, turn, role, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return turns.groupBy(F.col("conv_id").alias("row_id")).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def contents(messages: Column, *roles: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: m["content"])


def text_key(messages: Column) -> Column:
    """All contents but the system's, joined with one space."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: m["content"]), " ")


def md5_order(seed: int, key: Column) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def valid_chatml(messages: Column) -> Column:
    """Has a user and an assistant, no blank content, and each other turn has four letters or digits and no CJK."""
    talk = F.filter(messages, lambda m: m["role"] != "system")
    solid = F.forall(talk, lambda m: (F.length(F.regexp_replace(m["content"], r"[^A-Za-z0-9À-ɏ؀-ۿ]+", "")) >= 4) & ~m["content"].rlike(f"[{CJK}]"))
    return F.exists(messages, lambda m: m["role"] == "user") & F.exists(messages, lambda m: m["role"] == "assistant") & F.forall(messages, lambda m: F.trim(m["content"]) != "") & solid


def has_cjk(messages: Column) -> Column:
    return F.exists(messages, lambda m: (m["role"] != "system") & m["content"].rlike(f"[{CJK}]"))


def repeated_turn(messages: Column) -> Column:
    """Two user turns are equal after blanks collapse and a cut at 80 characters."""
    users = F.transform(contents(messages, "user"), lambda c: F.substring(F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")), 1, 80))
    return F.size(F.array_distinct(users)) < F.size(users)


def turn_count_agrees(messages: Column, multi_turn: Column) -> Column:
    return (F.size(contents(messages, "assistant")) > 1) == multi_turn


def is_parrot(messages: Column, n: int = 50) -> Column:
    """A user turn of n characters or more whose first n occur in the joined answers."""
    answers = F.array_join(contents(messages, "assistant"), "\n")
    return F.exists(contents(messages, "user"), lambda u: (F.length(u) >= n) & F.contains(answers, F.substring(u, 1, n)))


def drop_parrots(rows: DataFrame, max_share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(rows without parrots, report): the report has (component, n, parrots, failed), failed where their share reaches
    max_share."""
    marked = rows.withColumn("_parrot", is_parrot(F.col("messages")))
    report = marked.groupBy("component").agg(F.count("*").alias("n"), F.count_if("_parrot").alias("parrots")).withColumn("failed", F.col("parrots") >= max_share * F.col("n"))
    return marked.where("NOT _parrot").drop("_parrot"), report


# Tokens of the chat format, which no content may hold.
CONTROL_TOKENS = ("<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>")


def structural_problems(rows: DataFrame, tokens: tuple[str, ...] = CONTROL_TOKENS) -> DataFrame:
    """(problem, n): rows without a leading system turn, with a later one, that do not alternate, end on another role
    than the assistant's, hold empty content, or hold a control token."""
    m = F.col("messages")
    talk = F.filter(m, lambda x: x["role"] != "system")
    last = F.element_at(m, -1)["role"]
    problems = {
        "no_leading_system": F.coalesce(F.get(m, 0)["role"] != "system", F.lit(True)), "late_system": F.exists(F.slice(m, 2, 1_000_000), lambda x: x["role"] == "system"),
        "no_alternation": F.exists(F.transform(talk, lambda x, i: x["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b),
        "no_assistant_end": last != "assistant", "empty_content": F.exists(m, lambda x: F.trim(x["content"]) == ""),
        "control_token": F.exists(m, lambda x: reduce(lambda a, b: a | b, [F.contains(x["content"], F.lit(t)) for t in tokens], F.lit(False))),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in problems.items()]))
    return rows.where(F.size("messages") > 0).select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def length_report(rows: DataFrame, limit: int = 4096, count=word_count, max_dropped: float = 0.02) -> DataFrame:
    """One row: rows, quantiles of the token count (count: a column function, words by default), the assistant's share,
    rows over limit, and whether their share fails the run."""
    sized = rows.select(count(F.array_join(F.transform("messages", lambda m: m["content"]), " ")).alias("n"), count(F.array_join(contents(F.col("messages"), "assistant"), " ")).alias("a"))
    return sized.agg(F.count("*").alias("n_rows"), F.min("n").cast("long").alias("lo"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.9)).alias("p90"), F.percentile("n", F.lit(0.99)).alias("p99"), F.max("n").cast("long").alias("hi"), (F.sum("a") / F.sum("n")).alias("assistant_share"), F.count(F.when(F.col("n") > limit, 1)).alias("dropped"), F.coalesce(F.avg((F.col("n") > limit).cast("int")) >= max_dropped, F.lit(False)).alias("failed"))


def exact_dedup(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key in order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_place = 1").drop("_place")


def skip_seen(new: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """First new row of each key that seen does not have."""
    return exact_dedup(new.join(seen.select(key).distinct(), key, "left_anti"), key, order)


def split_rows(rows: DataFrame, stratum: str, eval_share: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with split: in md5 order the first floor(n * (1 - share)) of a stratum are train, the others eval."""
    by = Window.partitionBy(stratum)
    place = F.row_number().over(by.orderBy(md5_order(seed, F.col("row_id")), "row_id"))
    return rows.withColumn("split", F.when(place <= F.floor(F.count("*").over(by) * (1 - eval_share)), "train").otherwise("eval"))


def review_sample(rows: DataFrame, stratum: str, n: int = 2, seed: int = 42) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(md5_order(seed, F.col("row_id")), "row_id"))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def composition(rows: DataFrame) -> DataFrame:
    """(kind, value, n) for each component, domain and shard, from one pass over grouping sets."""
    sets = rows.groupingSets([["component"], ["domain"], ["shard"]], "component", "domain", "shard").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "component").when(F.col("g") == 5, "domain").otherwise("shard")
    return sets.select(kind.alias("kind"), F.coalesce("component", "domain", "shard").alias("value"), "n")


def split_composition(rows: DataFrame) -> DataFrame:
    """(component, n, train, eval, missing) of rows (component, split): a component that is trained on but not evaluated is
    missing, which fails a run."""
    counts = rows.groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "eval").alias("eval"))
    return counts.withColumn("missing", (F.col("train") > 0) & (F.col("eval") == 0))


def prompt_repetition(rows: DataFrame) -> DataFrame:
    """One row (n_rows, n_prompts, repetition): different leading texts of the rows, and how often each stands on average."""
    head = F.get("messages", F.lit(0))["content"]
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_distinct(head).alias("n_prompts"))
    return counts.withColumn("repetition", F.when(F.col("n_prompts") > 0, F.round(F.col("n_rows") / F.col("n_prompts"), 6)))


def shard_tally(rows: DataFrame, targets: dict[str, int]) -> DataFrame:
    """(shard, component, n, target, verdict) for every shard of rows (shard, component) and every component of targets: OK
    from the target on, else SHORT."""
    counts = rows.groupBy("shard", "component").agg(F.count("*").alias("k"))
    grid = counts.select("shard").distinct().select("shard", F.explode(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])).alias("component", "target"))
    tally = grid.join(counts, ["shard", "component"], "left").withColumn("n", F.coalesce("k", F.lit(0)))
    return tally.select("shard", "component", "n", "target", F.when(F.col("n") >= F.col("target"), "OK").otherwise("SHORT").alias("verdict"))


def oov_characters(docs: DataFrame, allowed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ch, n, n_docs): characters of the texts that allowed (ch) does not have, how often, and in how many rows. Characters are
    counted in each row first, so the shuffle sees a row for each kind of character of a text, and the vocabulary is met
    once for each kind of all. Null and empty texts have none; rows of one id count as one document in n_docs."""
    chars = docs.select(id_col, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "")).alias("ch")).where("ch <> ''")
    per = chars.groupBy("ch", id_col).agg(F.count("*").alias("n"))
    return per.groupBy("ch").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).join(allowed.select("ch").distinct(), "ch", "left_anti")


def apportion(weights: DataFrame, total: int, subset: list[str] | None = None) -> DataFrame:
    """weights (name, weight) with share: largest remainders, ties by name; the shares sum to total. With subset only those
    names share it; one that weights does not have is an error."""
    if subset is not None:
        weights = weights.where(F.col("name").isin(*subset))
        unknown = set(subset) - {r["name"] for r in weights.select("name").distinct().collect()}  # at most the names asked for
        if unknown:
            raise ValueError(f"unknown components: {sorted(unknown)}")
    every = Window.partitionBy()
    exact = F.col("weight") * F.lit(total) / F.sum("weight").over(every)
    parts = weights.withColumn("floor", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    left = F.lit(total) - F.sum("floor").over(every)
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "name"))
    return parts.withColumn("place", place).select("name", "weight", (F.col("floor") + F.when(F.col("place") <= left, 1).otherwise(0)).cast("long").alias("share"))


def topup_plan(existing: DataFrame, targets: DataFrame) -> DataFrame:
    """(component, target, have, missing, attempts): six attempts for each row that is missing from the target."""
    have = existing.groupBy("component").agg(F.count("*").alias("have"))
    joined = targets.join(have, "component", "left").withColumn("have", F.coalesce("have", F.lit(0)).cast("long"))
    missing = F.greatest(F.col("target") - F.col("have"), F.lit(0)).cast("long")
    return joined.withColumn("missing", missing).withColumn("attempts", missing * 6)


def dropped_questions(turns: DataFrame, keep: int = 2) -> DataFrame:
    """(conv_id, turn, question): sentences with a question mark from assistant turns older than the last `keep`."""
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    old = turns.where("role = 'assistant'").withColumn("age", age).where(F.col("age") > keep)
    asked = old.select("conv_id", "turn", F.explode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?؟])")).alias("q"))
    return asked.where(F.col("q").rlike(r"[?؟]")).select("conv_id", "turn", F.trim("q").alias("question"))
