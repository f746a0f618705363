"""Operator 4: preference formatting of chosen and rejected conversations.

A pair's chosen and rejected conversations are compared turn by turn. The longest
common prefix of turns is rendered once, as the prompt; what follows is rendered
per side as its completion. The result has one row per rendered turn, with a mask:
``trained`` is true for assistant turns of a completion, and of these the code points
from ``trained_from`` to ``trained_to`` (end exclusive) are trained on: the content and the mark that ends
it, not the header. DataFrame
functions only, and no conversation is gathered into one row or task.

A text can't forge a turn: where a text or role holds one of the marks, a backslash is put
behind its ``<`` (one more where some are there already, so that it can be taken back), and line
breaks in a role become blanks.

Edge cases: turns are ordered by ``turn``, null first; rows with the same turn are
one step, ordered by role and text, and steps are equal when they hold the same
rows as often; null roles and texts equal nulls and are rendered as empty; a
conversation that is a prefix of the other has an empty completion; equal
conversations have no completion at all; a pair of which one side is missing has
no prompt. Rows without pair id are left out. Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import table
from tidings.operators.profile import with_row_index
from tidings.session import stage

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
_MARK = r"<(\\*)\|im_(start|end)\|>"


def escaped(text: Column) -> Column:
    """The text with a backslash (one more) in every mark."""
    return F.regexp_replace(text, _MARK, r"<\\$1|im_$2|>")


def common_prefix(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per pair the first ``turn`` that differs (``cut``; null: none does). Steps
    are compared by count and by two sums of 64-bit hashes of their rows."""
    sides = [df.where("pair_id IS NOT NULL").select("pair_id", "turn", F.lit(side).alias("side"), *[
        F.xxhash64(F.lit(n), "role", F.col("role").isNull(), "text", F.col("text").isNull()).cast("decimal(20,0)").alias(f"h{n}") for n in (1, 2)])
        for side, df in ((1, chosen), (-1, rejected))]
    steps = sides[0].unionByName(sides[1]).groupBy("pair_id", "turn").agg(
        F.sum("side").alias("n"), F.sum(F.col("h1") * F.col("side")).alias("s1"), F.sum(F.col("h2") * F.col("side")).alias("s2"))
    differs = (F.col("n") != 0) | (F.col("s1") != 0) | (F.col("s2") != 0)
    first = F.min(F.when(differs, F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))))
    return steps.groupBy("pair_id").agg(first.alias("cut"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows (``pair_id``, ``turn``, ``role``, ``text``) of both sides to rendered
    turns: ``pair_id``, ``part`` (prompt, chosen, rejected), ``turn``, ``role``,
    ``rendered``, ``trained``. A part's rows in order of turn, role and text make its string."""
    cut = stage(common_prefix(chosen, rejected), "first-differences")
    both = chosen.select("pair_id", "turn", "role", "text", F.lit("chosen").alias("side")).unionByName(
        rejected.select("pair_id", "turn", "role", "text", F.lit("rejected").alias("side")))
    rows = both.join(cut, "pair_id")
    rows = rows.withColumns({"_head": F.concat(F.lit(BEGIN), F.translate(escaped(F.coalesce("role", F.lit(""))), "\n\r", "  "), F.lit("\n")),
                             "_body": F.concat(escaped(F.coalesce("text", F.lit(""))), F.lit(END))})
    prompt = F.col("cut").isNull() | (F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")) < F.col("cut"))
    rows = rows.withColumn("part", F.when(prompt, "prompt").otherwise(F.col("side"))).where((F.col("part") != "prompt") | (F.col("side") == "chosen"))
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    begin = F.length("_head").cast("long")
    return rows.select("pair_id", "part", "turn", "role", F.concat("_head", "_body").alias("rendered"), trained.alias("trained"),
                       F.when(trained, begin).alias("trained_from"), F.when(trained, begin + F.length("_body") - 1).alias("trained_to"))


def neighbour_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: each with an assistant turn is chosen over
    itself with the last such turn replaced by that of the next one (by id; the last takes the
    first's). A turn of several rows is replaced with all its assistant rows; what followed the
    turn goes. Conversations without an assistant turn make no pair, nor does a single one.

    The last turns and the neighbours are found on numbers (ids, turns and positions) and
    staged; no text is sorted or aggregated."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where("role = 'assistant' AND turn IS NOT NULL").groupBy("pair_id").agg(F.max("turn").alias("at"))
    last = stage(with_row_index(last, "pair_id", "_place"), "last-replies")
    n = max(last.count(), 1)
    following = last.select(((F.col("_place") + n - 1) % n).alias("_place"), F.col("pair_id").alias("other"), F.col("at").alias("other_at"))
    paired = stage(last.join(following, "_place").where("pair_id <> other").drop("_place"), "reply-pairs")
    both = turns.join(paired.select("pair_id", "at"), "pair_id")
    before = both.where("turn IS NULL OR turn < at")
    replies = turns.where("role = 'assistant'").withColumnRenamed("pair_id", "other").join(
        paired.withColumnRenamed("other_at", "turn"), ["other", "turn"]).select("pair_id", F.col("at").alias("turn"), "role", "text")
    return both.drop("at"), before.drop("at").unionByName(replies)


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(*neighbour_pairs(table(spark, sf_dir, "conversations")))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g')"
ORACLE = f"""
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
l AS (SELECT pair_id, max(turn) AS pos FROM t WHERE role = 'assistant' GROUP BY pair_id),
n AS (SELECT pair_id, pos, coalesce(lead(pair_id) OVER (ORDER BY pair_id), first_value(pair_id) OVER (ORDER BY pair_id)) AS other FROM l),
p AS (SELECT n.pair_id, n.pos, t.text FROM n JOIN l o ON o.pair_id = n.other JOIN t ON t.pair_id = o.pair_id AND t.turn = o.pos AND t.role = 'assistant' WHERE n.pair_id <> n.other),
c AS (SELECT t.* FROM t JOIN p USING (pair_id)),
r AS (SELECT t.* FROM t JOIN p USING (pair_id) WHERE turn < p.pos UNION ALL SELECT pair_id, pos, 'assistant', text FROM p),
d AS (SELECT pair_id, min(turn) AS cut FROM (
        SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn
        FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn
        WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) GROUP BY pair_id),
a AS (
  SELECT c.*, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE 'chosen' END AS part FROM c LEFT JOIN d USING (pair_id)
  UNION ALL
  SELECT r.*, 'rejected' FROM r JOIN d USING (pair_id) WHERE turn >= cut),
e AS (SELECT *, '{BEGIN}' || translate({_ESCAPED.format('role')}, chr(10) || chr(13), '  ') || chr(10) AS head,
             {_ESCAPED.format('text')} || '{END[:-1]}' || chr(10) AS body, part <> 'prompt' AND role = 'assistant' AS trained FROM a)
SELECT pair_id, part, turn, role, head || body AS rendered, trained,
       CASE WHEN trained THEN length(head) END AS trained_from, CASE WHEN trained THEN length(head) + length(body) - 1 END AS trained_to
FROM e
"""
