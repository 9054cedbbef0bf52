"""Quality rules by weak supervision (operator 9).

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates each rule's accuracy; the posterior probability of "good" then decides, rather than all rules at once.

Everything is made of SQL functions. Documents meet the model only through their vote pattern,
of which there are at most 3**8 = 6561: the patterns are counted with a map-side combine,
EM runs as one higher-order expression over that bounded array, and the table of posteriors,
again at most 6561 rows, is joined back by broadcast.

Null text counts as no words: such documents, and all under 50 words or with more than half of
their words in repeated 3-word windows, fail the base rules. Other columns pass through, one with the
name of a result as in_<name>; null ids stay null, and repeated rows each get their own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, apart, staged, text_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"
RULES = 8
ROUNDS = 25
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: rule, vote 1 if, vote -1 if; shared by Spark and the SQL oracle. A rule that looks for one defect says
#: nothing about the others, so it abstains where it finds none; only `prose` speaks for a document.
VOTES = [
    ("symbols", "false", "n_symbols * 10 >= n_words"),
    ("repeats", "false", "n_repeat_words * 10 >= 3 * n_words"),
    ("lines", "false", "n_dup_lines * 10 >= 4 * n_lines AND n_lines >= 4"),
    ("word_length", "false", "word_chars < 3 * n_words OR word_chars * 10 > 75 * n_words"),
    ("exclaims", "false", "n_exclaims * 5 >= n_words"),
    ("upper", "false", "n_upper * 10 >= 3 * word_chars"),
    ("variety", "false", "n_distinct * 5 <= n_words AND n_distinct < 200"),
    ("prose", "n_symbols = 0 AND n_exclaims * 50 <= n_words AND n_repeat_words * 10 <= n_words AND n_upper * 10 <= word_chars AND n_dup_lines * 10 <= 4 * n_lines AND word_chars * 10 BETWEEN 35 * n_words AND 65 * n_words", "n_words = 0"),
]
#: The class balance, which stays even so that the majority can't outvote a rare defect; every rule's accuracy at
#: the start of EM; and the pseudo-counts (right, all) of a rule.
SHARE, START_RIGHT, PSEUDO = 0.5, 0.9, (9.0, 10.0)


def _without(text: F.Column, characters: str) -> F.Column:
    return F.translate(text, characters, "")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """The counts that rules look at, added as columns; the text itself is no longer needed after."""
    t = text_of(text)
    triples = F.regexp_extract_all("_flat", F.lit(r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"), 1)
    df = df.withColumn("_text", t).withColumn("_flat", F.trim(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", " ")))
    df = df.withColumn("_words", F.when(F.col("_flat") == "", F.array().cast("array<string>")).otherwise(F.split("_flat", " ", -1)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.trim(_without(x, WHITE)) != ""))
    df = df.withColumn("_triples", triples)
    return df.select(
        *[c for c in df.columns if c not in ("_text", "_flat", "_words", "_lines", "_triples")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(F.col("_flat"), " ")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_text") - F.length(_without(F.col("_text"), "!"))).cast("long").alias("n_exclaims"),
        (F.length("_text") - F.length(_without(F.col("_text"), UPPER))).cast("long").alias("n_upper"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )


def _repeat_words() -> F.Column:
    """Words covered by 3-word windows that occur twice or more: equal windows are neighbours once sorted with their places."""
    places = F.expr("""
        size(array_distinct(flatten(element_at(transform(
          array(sort_array(transform(_triples, (w, i) -> named_struct('w', w, 'i', i)))),
          s -> transform(
            filter(arrays_zip(s, concat(array(cast(null as struct<w:string,i:int>)), s), slice(s, 2, size(s))),
                   z -> z.s.w = z['1'].w or z.s.w = z['2'].w),
            z -> array(z.s.i, z.s.i + 1, z.s.i + 2))), 1))))
    """)
    return F.when(F.size(F.array_distinct("_triples")) == F.size("_triples"), 0).otherwise(places)


def votes(df: DataFrame) -> DataFrame:
    """Adds `votes`, an array of 1, 0 and -1."""
    return df.withColumn("votes", F.array(*[F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for _, good, bad in VOTES]))


def _log_odds(s: str, v: str) -> str:
    return f"ln({s}.share / (1D - {s}.share)) + aggregate(sequence(0, {RULES - 1}), 0D, (x, j) -> x + {v}[j] * ln({s}.acc[j] / (1D - {s}.acc[j])))"


def posteriors(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(votes, posterior) of every vote pattern that occurs: at most 3**8 rows."""
    right, over = PSEUDO
    seen = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    q = f"1D / (1D + exp(-({_log_odds('s', 'p.v')})))"
    total = lambda x: f"aggregate(Q, 0D, (x, r) -> x + r.n * ({x}))"
    step = f"""element_at(transform(array(transform(P, p -> named_struct('v', p.v, 'n', p.n, 'q', {q}))), Q -> named_struct(
        'share', s.share,
        'acc', transform(sequence(0, {RULES - 1}), j -> ({total('case r.v[j] when 1 then r.q when -1 then 1D - r.q else 0D end')} + {right}D) / ({total('abs(r.v[j])')} + {over}D)))), 1)"""
    start = f"named_struct('share', {SHARE}D, 'acc', array_repeat({START_RIGHT}D, {RULES}))"
    model = seen.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("P"))
    model = model.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, t) -> {step})"))
    out = model.select("s", F.explode("P").alias("p"))
    return out.select(F.col("p.v").alias("votes"), F.expr(q).alias("posterior"))


def _judged(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    plain = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("body"))
    voted = staged(votes(features(plain, "body")).drop("body"), "op9-votes")
    model = F.broadcast(posteriors(voted))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.join(model, "votes", "left").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def judged(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns named in `keep` (default: all), the base counts, base_failed, posterior and kept."""
    keep = docs.columns if keep is None else keep
    results = [*BASE, "base_failed", "posterior", "kept"]
    return _judged(docs, text, keep).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(apart(keep, results))], *results)


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    return _judged(docs, text, docs.columns).where("kept").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    got = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return got.select("doc_id", *BASE, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


#: DuckDB: the counts of one row of `docs`; lists stand in for Spark's arrays.
FEATURES_SQL = r"""
raw AS (SELECT row_number() OVER () AS rid, d.*, coalesce(text, '') AS body FROM docs d),
toks AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM raw),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM toks)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM tri) WHERE c > 1) GROUP BY rid),
feats AS (SELECT t.* EXCLUDE (body, ws, ls), len(ws) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(ls) AS n_lines, length(body) - length(translate(body, '!', '')) AS n_exclaims, length(body) - length(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
    len(list_distinct(ws)) AS n_distinct FROM toks t LEFT JOIN rep USING (rid))"""


def _duck_odds() -> str:
    return "ln(share / (1 - share)) + " + " + ".join(f"v[{j}] * ln(acc[{j}] / (1 - acc[{j}]))" for j in range(1, RULES + 1))


def kept_sql(docs: str) -> str:
    """CTEs ending in `scored`: all columns of the relation `docs`, the counts, base_failed, posterior and kept."""
    right, over = PSEUDO
    case = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END" for _, good, bad in VOTES)
    acc = ", ".join(f"(sum(n * CASE v[{j}] WHEN 1 THEN q WHEN -1 THEN 1 - q ELSE 0 END) + {right}) / (sum(n * abs(v[{j}])) + {over})" for j in range(1, RULES + 1))
    start = ", ".join([f"CAST({START_RIGHT} AS DOUBLE)"] * RULES)
    return f"""docs AS ({docs}), {FEATURES_SQL},
voted AS MATERIALIZED (SELECT *, [{case}] AS v FROM feats),
pats AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY v),
em(t, share, acc) AS (
  SELECT 0, CAST({SHARE} AS DOUBLE), [{start}]
  UNION ALL
  SELECT t + 1, share, acc FROM (
    SELECT any_value(t) AS t, any_value(share) AS share, [{acc}] AS acc
    FROM (SELECT t, share, v, n, 1 / (1 + exp(-({_duck_odds()}))) AS q FROM em, pats WHERE t < {ROUNDS}) HAVING count(*) > 0)),
model AS (SELECT v, 1 / (1 + exp(-({_duck_odds()}))) AS posterior FROM em, pats WHERE t = {ROUNDS}),
scored AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND posterior >= 0.5 AS kept FROM voted JOIN model USING (v))"""


OP9_SQL = f"""WITH RECURSIVE {kept_sql('SELECT doc_id, text FROM documents')}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept, round(posterior, 6) AS posterior FROM scored"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": OP9_SQL}
