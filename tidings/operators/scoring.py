"""Batch scoring with a pluggable scorer, chat messages, usage and cost (M5-M7,
P10, P11, A22, A23, A25, A26).

The scorer is a user callable ``list[str] -> list[str]`` (raw answers). It
runs inside ``mapInPandas``: Spark partitions the rows, each Python worker
builds the scorer once per task (``scorer_factory``) and feeds it slices of
``batch_size`` texts. Errors are isolated per row (M6) and reported in
``status`` / ``error`` columns rather than silently stored as a label.
Everything around the scorer - filters, resume, parsing, metrics - stays in
JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions import text
from tidings.functions.parse import NEUTRAL, parse_label_strict

BATCH_SIZE = 32
# Fixed values that must equal the reference: the labelling price per token
# and the completion length assumed by the cost estimate.
INPUT_COST_PER_1K = 0.0025
OUTPUT_COST_PER_1K = 0.010
ASSUMED_COMPLETION_TOKENS = 30

# Fixed values that must equal the reference: system prompt of the few-shot
# evaluation, and the one of the numeric labeller.
EVAL_SYSTEM_PROMPT = (
    "Analyze the following article and classify its sentiment/outlook on the US stock market."
    "Task: Classify the article's sentiment toward the US stock market into one of five categories:"
    "POSITIVE - The article suggests optimistic outlook, growth, gains, bullish sentiment, or favorable conditions for US stocks"
    "LEANING POSITIVE - The article suggests an optimistic outlook, growth, gains, bullish sentiment, or favorable conditions for US stocks, but with some caveats or qualifiers"
    "NEUTRAL - The article presents balanced view, mixed signals, or is not directly related to US stock market sentiment"
    "LEANING NEGATIVE - The article suggests a pessimistic outlook, losses, bearish sentiment, concerns, or unfavorable conditions for US stocks, but with some caveats or qualifiers"
    "NEGATIVE - The article suggests pessimistic outlook, losses, bearish sentiment, concerns, or unfavorable conditions for US stocks"
    "Respond with ONLY ONE NUMBER: 4 - POSITIVE, 3 - LEANING POSITIVE, 2 - NEUTRAL, 1 - LEANING NEGATIVE, 0 - NEGATIVE"
)
LABELLER_SYSTEM_PROMPT = (
    "You are a financial sentiment analysis expert. Respond only with a number: 0 for negative, "
    "1 for leaning negative, 2 for neutral, 3 for leaning positive, or 4 for positive."
)

SCORED_SCHEMA = "{id} string, raw_response string, status string, error string"


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


ARTICLE_HEAD = "Article:\n"


def article_message(text_col) -> Column:
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.concat(F.lit(ARTICLE_HEAD), c)


def zero_shot_messages(text_col="text", system: str = EVAL_SYSTEM_PROMPT) -> Column:
    """P10: ``[system, user]`` chat messages."""
    return F.array(_msg("system", F.lit(system)), _msg("user", article_message(text_col)))


def few_shot_block(examples: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """P11 helper: the examples (at most one per class, W5) collapsed into one
    row holding the ordered ``(user, assistant)`` message pairs. Bounded: five
    rows in, one row out."""
    pairs = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(label_col).cast("int").alias("k"),
                                             F.col(text_col).alias("t")))),
        lambda e: F.array(_msg("user", article_message(e["t"])),
                          _msg("assistant", e["k"].cast("string"))))
    return examples.agg(F.flatten(pairs).alias("example_messages"))


def few_shot_messages(dataset: DataFrame, examples: DataFrame, text_col: str = "text",
                      system: str = EVAL_SYSTEM_PROMPT) -> DataFrame:
    """System, the example pairs, then the article. The example block is
    one value (at most five pairs by construction) computed once as a scalar
    subquery."""
    block = few_shot_block(examples).scalar()
    d = dataset.withColumn("_examples", block)
    msgs = F.concat(F.array(_msg("system", F.lit(system))),
                    F.coalesce(F.col("_examples"), F.array().cast(
                        "array<struct<role:string,content:string>>")),
                    F.array(_msg("user", article_message(text_col))))
    return d.withColumn("messages", msgs).drop("_examples")


def shared_prefix(examples: DataFrame, text_col: str = "text", label_col: str = "label", system: str = EVAL_SYSTEM_PROMPT) -> DataFrame:
    """What all few-shot conversations begin with, stored once: (prefix_id,
    position, message_id, role, content) of the system message and the example pairs (at
    most eleven rows). Ids are hashes of the content."""
    block = few_shot_block(examples, text_col, label_col).select(F.concat(
        F.array(_msg("system", F.lit(system))), F.coalesce("example_messages", F.array().cast("array<struct<role:string,content:string>>"))).alias("m"))
    block = block.withColumn("prefix_id", F.md5(F.array_join(F.transform("m", lambda x: F.md5(F.concat_ws("\n", x["role"], x["content"]))), ",")))
    rows = block.select("prefix_id", F.posexplode("m").alias("position", "x"))
    return rows.select("prefix_id", "position", F.md5("x.content").alias("message_id"), "x.role", "x.content")


def conversation_references(dataset: DataFrame, prefix: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """P11 by reference: (id, prefix_id, message_id) of every article's conversation; no
    example's text is repeated."""
    return dataset.select(id_col, prefix.agg(F.first("prefix_id")).scalar().alias("prefix_id"), F.md5(article_message(text_col)).alias("message_id"))


def message_store(dataset: DataFrame, prefix: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(message_id, role, content): every content that the conversations refer to, once.
    Of articles with the same text that with the smallest id supplies it: picked on ids, whole texts come from a semi join."""
    keyed = dataset.select(F.col(id_col).alias("_id"), F.md5(article_message(text_col)).alias("message_id"))
    first = keyed.groupBy("message_id").agg(F.min("_id").alias("_id")).select("_id")
    own = dataset.join(first, F.col(id_col) == F.col("_id"), "left_semi").select(
        F.md5(article_message(text_col)).alias("message_id"), F.lit("user").alias("role"), article_message(text_col).alias("content"))
    shared = prefix.select("message_id", "role", "content").dropDuplicates(["message_id"])  # at most eleven rows
    return shared.unionByName(own.join(shared.select("message_id"), "message_id", "left_anti"))


def _run_batches(scorer: Callable[[list[str]], list[str]], texts: list[str], batch_size: int):
    """Answers, statuses and errors aligned with ``texts``."""
    n = len(texts)
    answers: list = [None] * n
    status: list = ["ok"] * n
    errors: list = [None] * n
    for i in range(0, n, batch_size):
        btx = texts[i:i + batch_size]
        try:
            got = list(scorer(btx))
            if len(got) != len(btx):
                raise ValueError(f"scorer returned {len(got)} answers for {len(btx)} texts")
            answers[i:i + len(btx)] = got
        except Exception:  # noqa: BLE001 - isolate the failing rows (M6)
            for k, t in enumerate(btx, start=i):
                try:
                    (answers[k],) = scorer([t])
                except Exception as e:  # noqa: BLE001
                    status[k], errors[k] = "failed", f"{type(e).__name__}: {e}"
    return answers, status, errors


def ship_package_by_value() -> None:
    """Pickle this package's functions by value into Python workers, so a
    scorer runs even where ``tidings`` is not installed on the executors."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules["tidings"])


def _prefixed(scorer: Callable[[list[str]], list[str]], prefix: str) -> Callable[[list[str]], list[str]]:
    """The scorer of ``prefix + text``. A scorer that can read a prefix once offers
    ``with_prefix(prefix)``; for others it is put before each text, a batch at a time."""
    prepare = getattr(scorer, "with_prefix", None)
    return prepare(prefix) if prepare else lambda texts: scorer([prefix + t for t in texts])


def batch_order(texts: list[str]) -> list[int]:
    """Places of the texts by length (equal lengths as they come): batches of similar lengths need least padding."""
    return sorted(range(len(texts)), key=lambda k: len(texts[k]))


def score_texts(df: DataFrame, scorer_factory: Callable[[], Callable[[list[str]], list[str]]],
                id_col: str = "id", text_col: str = "text", batch_size: int = BATCH_SIZE,
                keep: list[str] | None = None, spread: int | None = None,
                prefixes: dict[str, str] | None = None, prefix_col: str | None = None,
                by_length: bool = True, profile=None) -> DataFrame:
    """M5 + M6: run ``scorer_factory()`` once per task over batches of
    ``batch_size`` texts. Output ``(id, *keep, raw_response, status, error)``.

    Filters must be applied before this call: Catalyst does not push
    predicates below ``mapInPandas``. Only the id, the text and the small
    ``keep`` columns cross into Python; carrying ``keep`` through avoids a
    join back to the (wide) input afterwards. ``spread=n`` hash-distributes
    the rows over ``n`` tasks by id first - for an expensive scorer whose
    input arrives in skewed partitions (e.g. after a join on a hot key).
    ``prefixes`` (a few strings by the value of the kept ``prefix_col``) are put
    before the texts inside the task, so that a shared prompt is sent once
    per task and not with every row; a scorer with a ``with_prefix`` method reads it once
    per task, too. Rows of a record batch are scored in order of
    length (``by_length``) and answered in their own. ``profile``: a
    ``ResourceProfile`` for the tasks that score (an accelerator, more memory), on clusters that have one.
    """
    ship_package_by_value()
    keep = list(keep or [])
    src = df.select(F.col(id_col).cast("string").alias(id_col), *keep, F.col(text_col).alias("_text"))
    if spread:
        src = src.repartition(spread, id_col)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    schema = f"`{id_col}` string, " + (kept + ", " if kept else "") + \
        "raw_response string, status string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        scorers = {k: _prefixed(scorer, p) for k, p in prefixes.items()} if prefixes else {None: scorer}
        for pdf in batches:
            texts = pdf["_text"].fillna("").astype(str).tolist()
            which = pdf[prefix_col].tolist() if prefixes else [None] * len(texts)
            order = batch_order(texts) if by_length else range(len(texts))
            result: list = [None] * len(texts)
            for name, score in scorers.items():
                places = [k for k in order if which[k] == name]
                answers = _run_batches(score, [texts[k] for k in places], batch_size)
                for k, *found in zip(places, *answers, strict=True):
                    result[k] = found
            out = pdf[[id_col] + keep].copy()
            out["raw_response"] = [None if a is None else str(a) for a, _, _ in result]
            out["status"] = [s for _, s, _ in result]
            out["error"] = [e for _, _, e in result]
            yield out

    return src.mapInPandas(run, schema, profile=profile)


def with_label(scored: DataFrame, parser=parse_label_strict, default_on_error: bool = False) -> DataFrame:
    """M6: parse the answer; failed calls get NULL unless ``default_on_error``
    stores the reference's neutral 2 (Q10)."""
    lab = parser(F.col("raw_response"))
    if default_on_error:
        lab = F.when(F.col("status") == "ok", lab).otherwise(F.lit(NEUTRAL))
    else:
        lab = F.when(F.col("status") == "ok", lab)
    return scored.withColumn("label", lab)


def not_yet_scored(articles: DataFrame, results: DataFrame | None, id_col: str = "id",
                   result_id: str = "id", join_hint: str | None = None) -> DataFrame:
    """M7: resume by id (Q15) - articles whose id has no successful result. One
    anti join that reads two narrow columns of the results. Two tables bucketed by id
    (:func:`tidings.sources.writers.write_bucketed`) meet without a shuffle; ``join_hint="merge"``
    keeps Spark from sending a small result table to all tasks instead."""
    if results is None:
        return articles
    results = results.hint(join_hint) if join_hint else results
    done = results.where(F.col("status") == "ok").select(F.col(result_id).alias("_done"))
    return articles.join(done, F.col(id_col).cast("string") == F.col("_done"), "left_anti")


def token_usage(scored: DataFrame, prompt_tokens: str = "prompt_tokens", answer_col: str = "raw_response",
                completion_tokens: str | None = None, prompt_col: str | None = None) -> DataFrame:
    """A23 inputs: per row ``prompt_tokens`` / ``completion_tokens``. A
    missing or zero reported count falls back to the length/4 estimate (P13)
    of the prompt (when ``prompt_col`` is given) or of the answer."""
    pt = F.col(prompt_tokens).cast("long")
    if prompt_col:
        pt = F.coalesce(F.nullif(pt, F.lit(0)), text.estimate_tokens(prompt_col))
    ct = F.col(completion_tokens).cast("long") if completion_tokens else F.lit(None).cast("long")
    est = text.estimate_tokens(F.coalesce(F.col(answer_col), F.lit("")))
    return (scored.withColumn("prompt_tokens", F.coalesce(pt, F.lit(0)).cast("long"))
                  .withColumn("completion_tokens", F.coalesce(F.nullif(ct, F.lit(0)), est)))


def usage_summary(usage: DataFrame, group_cols=()) -> DataFrame:
    """Successful / failed calls, tokens and cost. Failed calls carry no
    token counts (the reference counts only answered calls)."""
    ok = F.col("status") == "ok"
    inp = F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).cast("long")
    out = F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).cast("long")
    g = usage.groupBy(*group_cols).agg(F.count_if(ok).alias("total_api_calls"),
                                       F.count_if(~ok).alias("failed_api_calls"),
                                       inp.alias("total_input_tokens"), out.alias("total_output_tokens"))
    return (g.withColumn("total_tokens", F.col("total_input_tokens") + F.col("total_output_tokens"))
             .withColumn("input_cost", F.col("total_input_tokens") * (INPUT_COST_PER_1K / 1000))
             .withColumn("output_cost", F.col("total_output_tokens") * (OUTPUT_COST_PER_1K / 1000))
             .withColumn("total_cost", F.col("input_cost") + F.col("output_cost")))


def cost_estimate(articles: DataFrame, prompt: Column, order_col: str | None = None,
                  sample: int | None = None) -> DataFrame:
    """Estimated tokens and cost of labelling ``articles``.

    ``sample=None`` (default) sums the estimate over every article - one
    aggregate, cheap on Spark. ``sample=5`` with ``order_col`` reproduces the
    reference (mean of the first five prompts times the article count,
    truncated). Empty input -> zeros (Q16).
    """
    tok = text.estimate_tokens(prompt)
    n = F.count(F.lit(1))
    if sample is None:
        g = articles.agg(n.alias("num_articles"), F.coalesce(F.sum(tok), F.lit(0)).cast("long").alias("estimated_input_tokens"))
    else:
        head_avg = articles.orderBy(order_col).limit(sample).agg(F.avg(tok)).scalar()
        g = articles.agg(n.alias("num_articles"))
        g = g.select("num_articles", F.coalesce(F.floor(head_avg * F.col("num_articles")), F.lit(0))
                     .cast("long").alias("estimated_input_tokens"))
    g = g.withColumn("estimated_output_tokens", (F.col("num_articles") * ASSUMED_COMPLETION_TOKENS).cast("long"))
    return (g.withColumn("estimated_total_tokens", F.col("estimated_input_tokens") + F.col("estimated_output_tokens"))
             .withColumn("estimated_input_cost", F.col("estimated_input_tokens") * (INPUT_COST_PER_1K / 1000))
             .withColumn("estimated_output_cost", F.col("estimated_output_tokens") * (OUTPUT_COST_PER_1K / 1000))
             .withColumn("estimated_total_cost", F.col("estimated_input_cost") + F.col("estimated_output_cost")))


def batch_progress(scored: DataFrame, idx_col: str, batch_size: int = 50) -> DataFrame:
    """Per batch of ``batch_size`` consecutive indexes: rows, ok and
    failed rows, and whether the batch fully succeeded (true row counts, Q17)."""
    b = F.floor(F.col(idx_col) / batch_size).cast("long")
    g = scored.groupBy(b.alias("batch")).agg(
        F.min(idx_col).alias("first_idx"), F.max(idx_col).alias("last_idx"),
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("ok_rows"),
        F.count_if(F.col("status") != "ok").alias("failed_rows"))
    return g.withColumn("batch_ok", F.col("failed_rows") == 0)


POLARITY_SCHEMA = "polarity string, confidence double"


def score_polarity(df: DataFrame, polarity_factory, id_col: str = "id", text_col: str = "text",
                   batch_size: int = BATCH_SIZE, threshold: float = 0.75, keep: list[str] | None = None) -> DataFrame:
    """M5 + P18 + P19 for 3-class polarity scorers (``list[str] ->
    list[(label, score)]``): blank texts get the neutral 2 without a scorer
    call; other texts are scored in batches and bucketed into 0-4. One pass over
    the input; ``keep`` columns are carried through."""
    from tidings.functions.parse import bucket_polarity
    ship_package_by_value()
    keep = list(keep or [])
    src = df.select(F.col(id_col).cast("string").alias(id_col), *keep, F.when(~text.is_blank(text_col), F.col(text_col)).alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = polarity_factory()
        for pdf in batches:
            full = pdf["_text"].notna().to_numpy()
            answers, status, _ = _run_batches(scorer, pdf["_text"][full].astype(str).tolist(), batch_size)
            found, states = iter(answers), iter(status)
            answers = [next(found) if f else None for f in full]
            out = pdf[[id_col] + keep].copy()
            out["polarity"] = [a[0] if a else None for a in answers]
            out["confidence"] = [float(a[1]) if a else None for a in answers]
            out["status"] = [next(states) if f else "skipped" for f in full]
            yield out

    scored = src.mapInPandas(run, f"`{id_col}` string, {kept}{POLARITY_SCHEMA}, status string")
    lab = F.when(F.col("status") == "skipped", F.lit(NEUTRAL)).otherwise(bucket_polarity("polarity", "confidence", threshold))
    return scored.withColumn("label", lab)
