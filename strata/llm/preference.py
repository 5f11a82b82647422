"""Preference formatting with DataFrame functions only: shared turns become one prompt, the rest two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ChatML: a turn is <|im_start|>role, a line feed, the text, <|im_end|> and a line feed.
HEAD, BREAK, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{HEAD}', t.role, '\\n', t.text, '{TAIL[:-1]}\\n')), '')"


def _spans(turns: str, trained: str) -> str:
    """Character spans [start, end) of the trained roles' texts with their end marks, within the rendered turns."""
    head = f"{len(HEAD) + len(BREAK)} + length(t.role)"
    body = f"length(t.text) + {len(TAIL)}"
    return (
        f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int>>)), (s, t) -> named_struct("
        f"'at', s.at + {head} + {body}, 'spans', if(t.role = '{trained}', concat(s.spans, array(named_struct("
        f"'start', s.at + {head}, 'end', s.at + {head} + {body}))), s.spans)), s -> s.spans)"
    )


def format_preferences(turns: DataFrame, pairs: DataFrame | None = None, trained: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) -> a row for each pair of conversations.

    pairs(pair_id, chosen_id, rejected_id) names the pairs; without it conversations 2k (chosen) and 2k + 1 (rejected)
    form pair k (exact for any long), which takes one shuffle. Columns: pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen,
    rejected, chosen_mask, rejected_mask. The prompt renders the longest common prefix of turns (role and text equal)
    once; chosen and rejected render what follows; a mask lists the character spans of the trained role's texts.
    Texts are rendered as they stand: one that holds the marks of a turn reads like further turns, so such texts are to be
    escaped before, while masks keep to the turn's own characters. Turns go by (turn, role, text), null turns first; null texts are empty, null roles "unknown"; repeated turns stay.
    Rows with a null conv_id and pairs of which one conversation has no rows give no row; equal conversations give
    empty completions; an empty table gives no rows; other columns are ignored.
    """
    item = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id"), item.alias("item"))
    if pairs is None:
        conv = F.col("conv_id").cast("long")
        pair = rows.select(F.shiftright(conv, 1).alias("pair_id"), (conv.bitwiseAND(F.lit(1)) == 0).alias("first"), "item")
        both = pair.groupBy("pair_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("first"), F.col("item")))).alias("c"),
            F.array_sort(F.collect_list(F.when(~F.col("first"), F.col("item")))).alias("r"),
        )
        both = both.where((F.size("c") > 0) & (F.size("r") > 0)).select(
            "pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"), "c", "r"
        )
    else:
        whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("turns"))
        both = (
            pairs.select("pair_id", "chosen_id", "rejected_id")
            .join(whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id")
            .join(whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id")
        )
    least = "least(size(c), size(r))"
    differs = f"filter(sequence(0, {least} - 1), i -> c[i].role != r[i].role or c[i].text != r[i].text)"
    both = both.withColumn("n", F.expr(f"coalesce(array_min({differs}), {least})"))
    rest = lambda x: f"slice({x}, n + 1, size({x}))"
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.expr(_render("slice(c, 1, n)")).alias("prompt"),
        F.expr(_render(rest("c"))).alias("chosen"),
        F.expr(_render(rest("r"))).alias("rejected"),
        F.expr(_spans(rest("c"), trained)).alias("chosen_mask"),
        F.expr(_spans(rest("r"), trained)).alias("rejected_mask"),
    )
