"""Preference pairs: the longest common prefix of turns as one prompt, and two masked completions.

All of it is DataFrame and SQL functions: one shuffle brings a pair's turns together, the prefix is found
by comparing the two turn lists place by place, and texts are rendered from list slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.base import query, table

#: Template of a turn. A text that contains the marker's opening has it broken up, so it cannot forge turns.
OPEN, CLOSE, FORGED, BROKEN = "<|im_start|>", "<|im_end|>", "<|im_", "<| im_"
TRAINED = "assistant"


def turn_lists(turns: DataFrame, pair: str, **sides: Column) -> DataFrame:
    """One row per pair with a list of (turn, role, text) per side; a side's condition selects its rows."""
    one = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return turns.filter(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair_id")).agg(
        *[F.sort_array(F.collect_list(F.when(condition, one))).alias(name) for name, condition in sides.items()])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    shorter = F.least(F.size(a), F.size(b))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differing = F.filter(places, lambda i: ~(F.element_at(a, i)["role"].eqNullSafe(F.element_at(b, i)["role"])
                                             & F.element_at(a, i)["text"].eqNullSafe(F.element_at(b, i)["text"])))
    return F.coalesce(F.get(differing, F.lit(0)) - 1, shorter)


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit(FORGED), F.lit(BROKEN)), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """Runs of the completion's characters: (characters, whether they are trained on)."""
    def run(length: Column, trained: Column) -> Column:
        return F.struct(length.alias("n_chars"), trained.alias("trained"))
    return F.flatten(F.transform(turns, lambda t: F.array(
        run(F.char_length(head(t)), F.lit(False)),
        run(F.char_length(body(t)), F.coalesce(t["role"] == TRAINED, F.lit(False))),
        run(F.lit(1), F.lit(False)))))


def format_lists(lists: DataFrame) -> DataFrame:
    """Adds to columns chosen and rejected (turn lists): n_common, prompt, completions and masks."""
    shared = common_turns(F.col("chosen"), F.col("rejected"))
    out = lists.withColumn("n_common", shared)
    left = {s: F.slice(F.col(s), F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0)))
            for s in ("chosen", "rejected")}
    return out.withColumns({
        "prompt": rendered(F.slice("chosen", F.lit(1), F.col("n_common"))),
        **{f"{s}_completion": rendered(turns) for s, turns in left.items()},
        **{f"{s}_mask": mask(turns) for s, turns in left.items()}})


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair_id, n_common, prompt, chosen_completion, rejected_completion, chosen_mask, rejected_mask.

    Both tables have (pair, turn, role, text). Turns are in order of turn, role and text, nulls first;
    repeated rows are turns of their own. Null roles and texts are rendered empty and equal each other.
    Rows without a pair are in no pair. A pair with one side only, or with equal sides, has an empty
    completion there. Empty tables give no rows; other columns are not read. A pair is one row, so its
    turns are in one place, however long.
    """
    both = chosen.select(pair, "turn", "role", "text", F.lit(True).alias("__chosen")).unionByName(
        rejected.select(pair, "turn", "role", "text", F.lit(False).alias("__chosen")))
    lists = turn_lists(both, pair, chosen=F.col("__chosen"), rejected=~F.col("__chosen"))
    return format_lists(lists).drop("chosen", "rejected")


def weaker(turns: Column) -> Column:
    """The same conversation with its last assistant turn cut to the first half of its characters."""
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, i)))
    half = lambda t: F.substring(t["text"], F.lit(1), F.floor(F.char_length(t["text"]) / 2).cast("int"))
    return F.transform(turns, lambda t, i: F.struct(
        t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == last, half(t)).otherwise(t["text"]).alias("text")))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(
        r["n_chars"].cast("string"), F.when(r["trained"], ":1").otherwise(":0"))), ",")


_SIDE = """list_transform({0}, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10)
    || replace(coalesce(t.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10))"""
_RUNS = """list_transform({0}, lambda t: (13 + length(coalesce(t.role, '')))::VARCHAR || ':0,'
    || (length(replace(coalesce(t.text, ''), '<|im_', '<| im_')) + 10)::VARCHAR
    || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END || ',1:0')"""
_SQL = f"""
WITH lists AS (
  SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}}
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chosen
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
marked AS (
  SELECT *, list_max(list_transform(chosen, lambda t, i: CASE WHEN t.role = 'assistant' THEN i END)) AS last FROM lists),
pairs AS (
  SELECT *, list_transform(chosen, lambda t, i: {{'turn': t.turn, 'role': t.role,
      'text': CASE WHEN i = last THEN substring(t.text, 1, length(t.text) // 2) ELSE t.text END}}) AS rejected FROM marked),
cut AS (
  SELECT *, coalesce(list_min(list_filter(list_transform(chosen, lambda t, i: CASE WHEN
      t.role IS NOT DISTINCT FROM rejected[i].role AND t.text IS NOT DISTINCT FROM rejected[i].text THEN NULL ELSE i END),
      lambda x: x IS NOT NULL)) - 1, len(chosen)) AS n_common FROM pairs),
sides AS (
  SELECT conv_id, n_common, chosen[1:n_common] AS p, chosen[n_common + 1:] AS c, rejected[n_common + 1:] AS r FROM cut)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common,
  coalesce(array_to_string({_SIDE.format('p')}, ''), '') AS prompt,
  coalesce(array_to_string({_SIDE.format('c')}, ''), '') AS chosen_completion,
  coalesce(array_to_string({_SIDE.format('r')}, ''), '') AS rejected_completion,
  coalesce(array_to_string({_RUNS.format('c')}, ','), '') AS chosen_mask,
  coalesce(array_to_string({_RUNS.format('r')}, ','), '') AS rejected_mask
FROM sides"""


@query("op7_preference_format", _SQL)
def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen side, and with its last answer cut short as the rejected one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lists = turn_lists(turns, "conv_id", chosen=F.lit(True))
    out = format_lists(lists.withColumn("rejected", weaker(F.col("chosen"))))
    return out.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen_completion", "rejected_completion",
                      runs_text(F.col("chosen_mask")).alias("chosen_mask"), runs_text(F.col("rejected_mask")).alias("rejected_mask"))
