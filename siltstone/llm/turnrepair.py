"""Conversation structure repair (operator 13): the cheapest edits that make the turns of a conversation alternate.

A conversation is sound when its role initials read `(s?(ua)+)?`. Turns can be kept (0), re-roled to user or
assistant (1), deleted (2) or inserted with empty text (5); a turn without words, or with the role and text of an
earlier one, has to go; a turn that ends without `.`, `!` or `?` costs 5 more unless it is deleted. Of the cheapest edits
those whose initials (K, R, D, I in order) come first in ASCII are taken.

Windows over a conversation flag the faults; its turns are collected once, sorted, and aggregate() folds them: four
(cost, audit) structs, one for each state of the grammar (nothing yet, s, u, a), are carried from turn to turn by native
`least` expressions. Audits grow with the conversation, so turns are folded CHUNK at a time: inside a chunk the structs carry
the rank of the audit that they started from and only the letters since, which order as whole audits do; no step copies more than that.
An insertion is always dearer than deleting its neighbour, so it is never taken; the fold allows it all the same.

A conversation's repair and digest are sequential, so its turns meet in one task; they are shuffled once, by conversation, and
all windows and the collection share that exchange.

Nulls count as one space in role and text, also in the damage; null conversation ids are one conversation; null turns come
first and count for no gap. Equal turns are ordered by role, then text, so repeated rows are duplicates whatever their
order in the table. A role of no characters has no initial, so its turn is not kept as it is. `turn` is a whole number. A conversation without turns gets zeros and empty results; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
RULES = 20
#: Costs of the edits, and of a truncated turn that stays; the cost of a state that can't be reached; turns folded at once.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEVER = 1 << 40
CHUNK = 64
STATES = "esua"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `kept`, after the damage that crc32 of conv_id:turn chooses: rows that it drops have kept false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(RULES)).alias("rule"))
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("rule") == 4, "user").otherwise(F.col("role"))
    df = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("rule") != 0).alias("kept"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("rule") == 3, 2).otherwise(1))))
    return df.drop("col")


def _flagged(df: DataFrame) -> DataFrame:
    """Each turn with its place n and its faults."""
    order = Window.partitionBy("conv", "kept").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    df = df.withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("initial").over(order)).withColumn("turn_before", F.lag("turn").over(order))
    seen = F.row_number().over(Window.partitionBy("conv", "kept", "role", "text").orderBy("n")) > 1
    solid = F.rtrim("text", F.lit(WHITE))
    blank = F.rtrim(F.ltrim(solid, F.lit(WHITE)), F.lit(WHITE)) == ""
    df = df.withColumn("blank", blank).withColumn("duplicate", ~F.col("blank") & seen)
    df = df.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.substring(solid, -1, 1).isin(*STOPS))
    df = df.withColumn("illegal", F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au"))
    return df.withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")))


def _step(x: Column, cost, letter: str) -> Column:
    return F.struct((x["cost"] + cost).alias("cost"), x["rank"].alias("rank"), F.concat(x["tail"], F.lit(letter)).alias("tail"), x["start"].alias("start"))


def _only_if(condition: Column, x: Column) -> Column:
    """x, or a struct of cost NEVER."""
    return F.struct(F.when(condition, x["cost"]).otherwise(F.lit(NEVER)).alias("cost"), x["rank"].alias("rank"), x["tail"].alias("tail"), x["start"].alias("start"))


def _four(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _bound(x: Column, then) -> Column:
    """then(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _inserted(x: Column) -> Column:
    """What insertions after a turn reach from its four structs."""
    with_u = _bound(x, lambda x: _four(x["e"], x["s"], F.least(x["u"], *[_step(x[k], INSERT, "I") for k in "esa"]), x["a"]))
    return _bound(with_u, lambda x: _four(x["e"], x["s"], x["u"], F.least(x["a"], _step(x["u"], INSERT, "I"))))


def _turn(x: Column, t: Column) -> Column:
    """The four structs after turn t."""
    stays = ~t["must_go"]
    more = F.when(t["cut"], F.lit(CUT_OFF)).otherwise(F.lit(0))
    gone = {k: _step(x[k], DELETE, "D") for k in STATES}

    def to(role: str, *sources: str) -> list[Column]:
        kept = [_only_if(stays & (t["initial"] == role), _step(x[k], more, "K")) for k in sources]
        return kept if role == "s" else kept + [_only_if(stays, _step(x[k], more + REROLE, "R")) for k in sources]

    after = _four(gone["e"], F.least(gone["s"], *to("s", "e")), F.least(gone["u"], *to("u", "e", "s", "a")), F.least(gone["a"], *to("a", "u")))
    return _inserted(after)


def _fold(turns: Column) -> Column:
    """struct(cost, audit) of the cheapest edits of a sorted array of turns."""
    def pair(cost: int, audit: str) -> Column:
        return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))

    def chunk(x: Column, k: Column) -> Column:
        audits = [x[s]["audit"] for s in STATES]

        def started(i: int) -> Column:
            rank = sum((F.when(other < audits[i], 1).otherwise(0) for other in audits), F.lit(0))
            return F.struct(x[STATES[i]]["cost"].alias("cost"), rank.alias("rank"), F.lit("").alias("tail"), F.lit(i).alias("start"))

        inner = F.aggregate(F.slice(turns, k * CHUNK + 1, F.lit(CHUNK)), _four(*[started(i) for i in range(4)]), _turn)
        whole = lambda y, s: F.struct(y[s]["cost"].alias("cost"), F.concat(F.element_at(F.array(*audits), y[s]["start"] + 1), y[s]["tail"]).alias("audit"))
        return _bound(inner, lambda y: _four(*[whole(y, s) for s in STATES]))

    empty = _four(pair(0, ""), pair(NEVER, ""), pair(INSERT, "I"), pair(2 * INSERT, "II"))
    chunks = F.when(F.size(turns) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / CHUNK).cast("int")))
    return F.aggregate(chunks, empty, chunk, lambda x: F.least(x["e"], x["a"]))


def _rebuilt(turns: Column, audit: Column) -> Column:
    """The repaired turns, array of (role, text)."""
    letters = F.transform(F.filter(F.split(audit, ""), lambda x: x != ""), lambda x, i: F.struct(i.alias("at"), x.alias("edit")))
    rows = F.zip_with(turns, F.filter(letters, lambda x: x["edit"] != "I"), lambda t, x: F.struct(x["at"].alias("at"), x["edit"].alias("edit"), t["role"].alias("role"), t["text"].alias("text")))
    new = F.transform(F.filter(letters, lambda x: x["edit"] == "I"), lambda x: F.struct(x["at"].alias("at"), x["edit"].alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")))
    stay = F.filter(F.array_sort(F.concat(rows, new)), lambda x: x["edit"] != "D")

    def named(stay: Column) -> Column:
        lead = F.when((F.get(stay, F.lit(0))["edit"] == "K") & F.get(stay, F.lit(0))["role"].startswith("s"), 1).otherwise(0)
        role = lambda x, i: F.when(x["edit"] == "K", x["role"]).when((i - lead) % 2 == 0, "user").otherwise("assistant")
        return F.transform(stay, lambda x, i: F.struct(role(x, i).alias("role"), x["text"].alias("text")))

    return _bound(stay, named)


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation; repaired is its turns after the
    edits, an array of (role, text). A boolean column `kept` marks the rows that count; conversations without any are still returned."""
    there = F.coalesce(F.col("kept"), F.lit(False)) if "kept" in turns.columns else F.lit(True)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), there.alias("kept"))
    df = _flagged(df.withColumn("initial", F.substring("role", 1, 1)).repartition("conv"))
    count = lambda c: F.sum(F.when(F.col("kept") & F.col(c), 1).otherwise(0)).cast("long").alias(c)
    one = F.struct("n", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), F.col("truncated").alias("cut"), "role", "text")
    ends = F.max(F.when(F.col("kept"), F.col("turn"))) - F.min(F.when(F.col("kept"), F.col("turn"))) + 1
    out = df.groupBy("conv").agg(
        F.coalesce(ends - F.sum(F.when(F.col("kept") & F.col("new_turn"), 1).otherwise(0)), F.lit(0)).cast("long").alias("gaps"),
        *[count(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.array_sort(F.collect_list(F.when(F.col("kept"), one))).alias("turns"),
    )
    out = out.withColumn("best", _fold(F.col("turns")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    return out.select(F.col("conv").alias(conv), *counts, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), _rebuilt(F.col("turns"), F.col("best.audit")).alias("repaired"))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    got = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return got.withColumn("repaired_sha256", F.sha2(F.concat_ws("\n", lines), 256)).drop("repaired")


def _sql() -> str:
    """The same by a recursive query that keeps a string (cost in twelve digits, audit) for each state."""
    def add(x: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST({x}[1:13] AS BIGINT) + {cost} AS VARCHAR), 13, '0') || {x}[14:] || '{letter}')"

    never = f"{NEVER:013d}"
    keep = lambda role, x: f"CASE WHEN NOT must_go AND initial = '{role}' THEN {add(x, 'extra', 'K')} ELSE '{never}' END"
    role = lambda x: f"CASE WHEN NOT must_go THEN {add(x, f'extra + {REROLE}', 'R')} ELSE '{never}' END"
    to_u = ", ".join(f(x) for x in "esa" for f in (lambda x: keep("u", x), role))
    insert = lambda *xs: ", ".join(add(x, str(INSERT), "I") for x in xs)
    return rf"""WITH RECURSIVE byte_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
ruled AS (SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {RULES} AS r FROM keyed, byte_table),
hurt AS (SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role, CASE WHEN r = 1 THEN '' WHEN r = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN r = 3 THEN [1, 2] ELSE [1] END) AS copy FROM ruled WHERE r <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, role[1:1] AS initial FROM hurt),
faults AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS open_end, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
turns AS MATERIALIZED (SELECT *, is_blank OR seen AS must_go, CASE WHEN NOT is_blank AND NOT seen AND open_end THEN {CUT_OFF} ELSE 0 END AS extra, before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS is_illegal FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND seen) AS duplicate, count(*) FILTER (extra > 0) AS truncated, count(*) FILTER (is_illegal) AS illegal, max(n) AS last FROM turns GROUP BY conv_id),
dp(conv_id, n, e, s, u, a) AS (SELECT conv_id, 0, '{0:013d}', '{never}', '{INSERT:013d}I', '{2 * INSERT:013d}II' FROM counts
 UNION ALL SELECT conv_id, n, e, s, u2, least(a, {insert("u2")}) FROM (SELECT conv_id, n, e, s, a, least(u, {insert("e", "s", "a")}) AS u2 FROM (SELECT d.conv_id, t.n, {add("e", str(DELETE), "D")} AS e, least({add("s", str(DELETE), "D")}, {keep("s", "e")}) AS s, least({add("u", str(DELETE), "D")}, {to_u}) AS u, least({add("a", str(DELETE), "D")}, {keep("a", "u")}, {role("u")}) AS a
 FROM dp d JOIN turns t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.n = d.n + 1))),
best AS (SELECT c.*, least(d.e, d.a) AS x FROM counts c JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.n = c.last),
edits AS (SELECT t.conv_id, t.n, t.role, t.text, t.initial, b.x[13 + t.n : 13 + t.n] AS edit FROM turns t JOIN best b ON b.conv_id IS NOT DISTINCT FROM t.conv_id),
outs AS (SELECT *, row_number() OVER w AS p, first_value(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER w AS lead FROM edits WHERE edit <> 'D' WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (p - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY n) AS whole FROM outs GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(x[1:13] AS BIGINT), 0) AS cost, coalesce(x[14:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts x1 ON x1.conv_id IS NOT DISTINCT FROM o.conv_id"""


QUERIES = {"op13_turn_repair": op13_turn_repair}
SQL = {"op13_turn_repair": _sql()}
