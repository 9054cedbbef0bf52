"""Chat formatting of preferences (operator 8).

A pair is a chosen and a rejected conversation, each an array of (role, text). Their longest common
prefix of whole turns is rendered once as the prompt; what follows it in either is rendered as a
completion, with the spans of characters that loss is taken on: the text and end mark of assistant turns.
Everything is a projection of two arrays, so pairs need no exchange at all.

Turns differ if role or text differ, compared as rendered. Null roles read `user`, null texts are empty. A mark inside a text is
broken up so that no text can open or close a turn. Identical conversations have empty completions
(status `identical`); a missing side gives null completions (status `unpaired`). Texts are taken whole, however long. Two rows of
one turn that differ are two turns, in order of role and text; equal ones are one. Empty tables give no rows. Other columns pass
through, one with the name of a result as in_<name>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"
RESULTS = ["status", "n_prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask"]


def _clean(turns: str) -> str:
    return f"transform({turns}, t -> named_struct('role', coalesce(t.role, 'user'), 'text', replace(coalesce(t.text, ''), '<|', '< |')))"


def _render(turns: str) -> str:
    return rf"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '\n', t.text, '{CLOSE}\n')), '')"


def _mask(turns: str) -> str:
    head, body = f"{len(OPEN) + 1} + length(t.role)", f"length(t.text) + {len(CLOSE)}"
    span = f"concat(if(a.spans = '', '', ','), a.at + {head}, '-', a.at + {head} + {body})"
    return f"aggregate({turns}, named_struct('at', 0, 'spans', ''), (a, t) -> named_struct('at', a.at + {head} + {body} + 1, 'spans', concat(a.spans, if(t.role = 'assistant', {span}, ''))), a -> a.spans)"


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The other columns of pairs with status, n_prompt_turns, prompt, and text and mask of both completions."""
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    names = apart(others, RESULTS)
    df = pairs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(others)], F.expr(_clean(f"`{chosen}`")).alias("c"), F.expr(_clean(f"`{rejected}`")).alias("r"))
    df = df.withColumn("differ", F.expr("array_position(zip_with(c, r, (x, y) -> x <=> y), false)"))
    df = df.withColumn("n", F.expr("case when c is null or r is null then null when differ = 0 then size(c) else cast(differ - 1 as int) end"))
    df = df.withColumn("cr", F.expr("slice(c, n + 1, greatest(size(c) - n, 0))")).withColumn("rr", F.expr("slice(r, n + 1, greatest(size(r) - n, 0))"))
    return df.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)],
        F.expr("case when c is null or r is null then 'unpaired' when differ = 0 then 'identical' else 'pair' end").alias("status"),
        F.expr("cast(coalesce(n, 0) as bigint)").alias("n_prompt_turns"),
        F.expr(_render("slice(c, 1, n)")).alias("prompt"),
        F.expr(_render("cr")).alias("chosen_text"), F.expr(_mask("cr")).alias("chosen_mask"),
        F.expr(_render("rr")).alias("rejected_text"), F.expr(_mask("rr")).alias("rejected_mask"),
    )


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns in order; repeated rows count once. Rows without conv_id are in no conversation."""
    told = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return told.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): a conversation up to its last reply, and its first turns followed by what its neighbour, the
    conversation whose id differs in the last bit, has from there up to its own last reply. They part after conv_id modulo the
    number of turns, or later where turns happen to agree. Null where a conversation or its neighbour has no reply."""
    told = conversations_of(turns).withColumn("last", F.expr("array_max(transform(turns, (t, i) -> if(t.role = 'assistant', i + 1, 0)))"))
    told = told.select("conv_id", F.expr("if(last > 0, transform(slice(turns, 1, last), t -> named_struct('role', t.role, 'text', t.text)), null)").alias("own"))
    other = told.select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"), F.col("own").alias("their"))
    both = told.join(other, "conv_id", "left").withColumn("cut", F.expr("cast(pmod(conv_id, size(own)) as int)"))
    rest = "slice(their, cut + 1, greatest(size(their) - cut, 0))"
    return both.select("conv_id", F.col("own").alias("chosen"), F.expr(f"if(own is not null and their is not null, concat(slice(own, 1, cut), {rest}), cast(null as array<{TURN}>))").alias("rejected"))


def op8_preference_formatting(spark, sf_dir: str) -> DataFrame:
    return formatted(reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _side_sql(name: str, turns: str) -> str:
    """CTE with text and mask of what a side has after the prompt."""
    return rf"""{name} AS (SELECT conv_id, string_agg(line, '' ORDER BY i) AS text, string_agg(CASE WHEN role = 'assistant' THEN (pos + head) || '-' || (pos + head + body) END, ',' ORDER BY i) AS mask FROM (
  SELECT conv_id, i, role, line, head, body, coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM (
    SELECT x.conv_id, x.i, x.role, x.line, 13 + length(x.role) AS head, length(x.text) + 10 AS body FROM {turns} x JOIN n USING (conv_id) WHERE x.i > n.same)) GROUP BY conv_id)"""


OP8_SQL = rf"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role, replace(text, '<|', '< |') AS text FROM t),
k AS (SELECT conv_id, coalesce(max(CASE WHEN role = 'assistant' THEN i END), 0) AS last FROM o GROUP BY conv_id),
c AS (SELECT conv_id, i, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM o JOIN k USING (conv_id) WHERE i <= last),
p AS (SELECT a.conv_id, a.last, b.conv_id AS other, ((a.conv_id % a.last) + a.last) % a.last AS cut FROM k a JOIN k b ON b.conv_id = xor(a.conv_id, 1) WHERE a.last > 0 AND b.last > 0),
ch AS (SELECT c.* FROM c JOIN p USING (conv_id)),
re AS (SELECT c.* FROM c JOIN p USING (conv_id) WHERE c.i <= p.cut UNION ALL SELECT p.conv_id, c.i, c.role, c.text, c.line FROM c JOIN p ON c.conv_id = p.other WHERE c.i > p.cut),
d AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.i, b.i)) AS first FROM ch a FULL JOIN re b ON a.conv_id = b.conv_id AND a.i = b.i WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
n AS (SELECT p.conv_id, CASE WHEN d.first IS NULL THEN 'identical' ELSE 'pair' END AS status, coalesce(d.first - 1, p.last) AS same FROM p LEFT JOIN d USING (conv_id)),
pr AS (SELECT conv_id, string_agg(line, '' ORDER BY i) AS prompt FROM ch JOIN n USING (conv_id) WHERE i <= same GROUP BY conv_id),
{_side_sql('ct', 'ch')}, {_side_sql('rt', 're')}
SELECT k.conv_id, coalesce(n.status, 'unpaired') AS status, CAST(coalesce(n.same, 0) AS BIGINT) AS n_prompt_turns,
  CASE WHEN n.status IS NOT NULL THEN coalesce(prompt, '') END AS prompt,
  CASE WHEN n.status IS NOT NULL THEN coalesce(ct.text, '') END AS chosen_text, CASE WHEN n.status IS NOT NULL THEN coalesce(ct.mask, '') END AS chosen_mask,
  CASE WHEN n.status IS NOT NULL THEN coalesce(rt.text, '') END AS rejected_text, CASE WHEN n.status IS NOT NULL THEN coalesce(rt.mask, '') END AS rejected_mask
FROM k LEFT JOIN n USING (conv_id) LEFT JOIN pr USING (conv_id) LEFT JOIN ct USING (conv_id) LEFT JOIN rt USING (conv_id)"""

QUERIES = {"op8_preference_formatting": op8_preference_formatting}
SQL = {"op8_preference_formatting": OP8_SQL}
