"""Quality rules as weak supervision.

Every rule votes good, bad or abstains on a document. Expectation-maximisation over the counts
of vote patterns estimates how often each rule votes bad on good documents and on each kind of
junk; the posterior probability of "good" then decides, instead of the demand that all rules
pass. Junk is not of one kind (symbol litter and repeated lines seldom meet), so there is a
class for each anchor rule, and the probability of junk is that of all those classes together.

Only DataFrame functions are used. EM runs over at most 3^rules patterns, whatever the number
of documents, as one expression over one row.

Defined results: a null or wordless text has no words and fails the base rule; rows with equal
or null ids are judged one by one; an empty table gives an empty result. Other columns, also
ones with the names used here, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlog.session import scratch_path

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
EM_ROUNDS = 15
# Before EM: share of good documents and rates of bad votes, worth PRIOR_WEIGHT documents. A rule
# is taken to be right on good documents at least 1 - MAX_BAD_ON_GOOD of the time, and an anchor
# rule to fire on at least half of its kind of junk.
PRIOR_GOOD, PRIOR_BAD_ON_GOOD, PRIOR_ANCHOR, PRIOR_OTHER = 0.8, 0.01, 0.9, 0.1
PRIOR_WEIGHT, MAX_BAD_ON_GOOD, MIN_ANCHOR = 10.0, 0.05, 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_lines", "n_upper", "n_distinct")

# (bad if, good if) over the measures, in integers; both false or the base unknown: abstain.
RULES = {
    "word_length": (
        "word_chars * 10 < n_words * 20 OR word_chars * 10 > n_words * 120",
        "word_chars * 10 >= n_words * 30 AND word_chars * 10 <= n_words * 90",
    ),
    "symbols": ("n_symbols * 100 > n_words * 30", "n_symbols * 100 <= n_words * 10"),
    "lines": (
        "n_lines >= 3 AND n_dup_lines * 100 > n_lines * 30",
        "n_dup_lines * 100 <= n_lines * 10",
    ),
    "repeats": ("n_repeat_words * 100 > n_words * 30", "n_repeat_words * 100 <= n_words * 15"),
    "upper": ("n_upper * 100 > word_chars * 40", "n_upper * 100 <= word_chars * 15"),
    "variety": ("n_distinct * 100 < n_words * 15", "n_distinct * 100 >= n_words * 25"),
}
ANCHORS = ("word_length", "symbols", "repeats", "upper")


def start_rates() -> list[list[float]]:
    """Rates of bad votes by class (good first, then a class for each anchor) and rule."""
    kinds = [[PRIOR_ANCHOR if r == a else PRIOR_OTHER for r in RULES] for a in ANCHORS]
    return [[PRIOR_BAD_ON_GOOD] * len(RULES), *kinds]


def start_shares() -> list[float]:
    return [PRIOR_GOOD] + [(1 - PRIOR_GOOD) / len(ANCHORS)] * len(ANCHORS)


def rate_limits() -> list[list[tuple[float, float]]]:
    kinds = [[(MIN_ANCHOR if r == a else 0.001, 0.999) for r in RULES] for a in ANCHORS]
    return [[(0.0001, MAX_BAD_ON_GOOD)] * len(RULES), *kinds]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more in the array.

    Windows are sorted by hash, so equal ones are neighbours; the work is n log n.
    """
    windows = F.when(
        F.size(words) > width,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (width - 1)),
            lambda i: F.struct(
                F.xxhash64(*(F.get(words, i + (j - 1)) for j in range(width))).alias("h"),
                i.alias("i"),
            ),
        ),
    )

    def marked(s: Column) -> Column:
        def position(k: Column) -> Column:
            own = F.get(s, k - 1)["h"]
            same = own.eqNullSafe(F.get(s, k - 2)["h"]) | own.eqNullSafe(F.get(s, k)["h"])
            return F.when(same, F.get(s, k - 1)["i"])

        return F.sort_array(
            F.filter(F.transform(F.sequence(F.lit(1), F.size(s)), position), lambda p: p.isNotNull())
        )

    def covered(p: Column) -> Column:
        steps = F.transform(
            F.sequence(F.lit(1), F.size(p)),
            lambda k: F.least(F.lit(width), F.coalesce(F.get(p, k) - F.get(p, k - 1), F.lit(width))),
        )
        total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(F.size(p) > 0, total).otherwise(F.lit(0).cast("bigint"))

    # A one-element array binds an intermediate result to a lambda variable.
    positions = F.transform(F.array(F.sort_array(windows)), marked)
    return F.coalesce(F.get(F.transform(positions, covered), F.lit(0)), F.lit(0).cast("bigint"))


def measures(text: Column) -> Column:
    """A struct of the measures, all bigint."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def chars(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def over(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            chars(f"{WHITE}+").cast("bigint").alias("word_chars"),
            chars(f"[^{SYMBOLS}]+").cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated_window_words(words).alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
            chars("[^A-Z]+").cast("bigint").alias("n_upper"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        )

    return F.get(F.transform(F.array(words_of(text)), over), F.lit(0))


def votes_sql(prefix: str = "") -> str:
    """One character a rule: b(ad), g(ood) or - (abstains). The same text in both SQL dialects."""
    parts = []
    for bad, good in RULES.values():
        parts.append(f"CASE WHEN n_words = 0 THEN '-' WHEN {bad} THEN 'b' WHEN {good} THEN 'g' ELSE '-' END")
    sql = " || ".join(f"({p})" for p in parts)
    for name in MEASURES:
        sql = sql.replace(name, prefix + name) if prefix else sql
    return sql


BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def _sql_array(values) -> str:
    if isinstance(values, (list, tuple)):
        return f"array({', '.join(map(_sql_array, values))})"
    return f"CAST({values} AS DOUBLE)"


def pattern_posteriors(patterns: DataFrame) -> DataFrame:
    """(votes, n) to (votes, p_good): EM over the few distinct vote patterns, in one row.

    The state of EM is one flat array of rates by class and rule, and one of class shares.
    """
    m, k = len(RULES), len(ANCHORS) + 1
    start = f"named_struct('pi', {_sql_array(start_shares())}, 'r', {_sql_array(start_rates())})"
    lows = _sql_array([[low for low, _ in row] for row in rate_limits()])
    highs = _sql_array([[high for _, high in row] for row in rate_limits()])

    def weights(state: str) -> str:
        """Probabilities of the classes of pattern p, before they are scaled to one."""
        log = f"""aggregate(sequence(1, {m}), ln({state}.pi[c - 1]), (a, j) -> a +
            CASE substr(p.votes, j, 1) WHEN 'b' THEN ln({state}.r[c - 1][j - 1])
                 WHEN 'g' THEN ln(1 - {state}.r[c - 1][j - 1]) ELSE 0 END)"""
        raw = f"transform(sequence(1, {k}), c -> exp({log}))"
        return f"""transform(array({raw}), w -> transform(w, x ->
            x / aggregate(w, CAST(0 AS DOUBLE), (a, y) -> a + y)))[0]"""

    def total(term: str) -> str:
        return f"aggregate(q, CAST(0 AS DOUBLE), (a, x) -> a + ({term}))"

    bad = "CASE WHEN substr(x.votes, j, 1) = 'b' THEN x.n * x.w[c - 1] ELSE 0 END"
    voted = "CASE WHEN substr(x.votes, j, 1) <> '-' THEN x.n * x.w[c - 1] ELSE 0 END"
    prior = f"{_sql_array(start_rates())}[c - 1][j - 1]"
    rate = f"({total(bad)} + {prior} * {PRIOR_WEIGHT}) / ({total(voted)} + {PRIOR_WEIGHT})"
    share = f"""({total('x.n * x.w[c - 1]')} + {_sql_array(start_shares())}[c - 1] * {PRIOR_WEIGHT})
        / ({total('x.n')} + {PRIOR_WEIGHT})"""
    update = f"""transform(array(transform(ps, p -> named_struct('votes', p.votes, 'n', p.n,
        'w', {weights("s")}))), q -> named_struct(
            'pi', transform(sequence(1, {k}), c -> {share}),
            'r', transform(sequence(1, {k}), c -> transform(sequence(1, {m}), j ->
                greatest({lows}[c - 1][j - 1], least({highs}[c - 1][j - 1], {rate}))))))[0]"""
    gathered = patterns.agg(
        F.array_sort(
            F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))
        ).alias("ps")
    )
    fitted = gathered.withColumn(
        "fit", F.expr(f"aggregate(sequence(1, {EM_ROUNDS}), {start}, (s, r) -> {update})")
    )
    return fitted.select(
        F.explode(
            F.expr(f"transform(ps, p -> named_struct('votes', p.votes, 'p_good', {weights('fit')}[0]))")
        ).alias("r")
    ).select("r.votes", "r.p_good")


def _counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


def judge_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, quality_probability and kept.

    Measures are taken once and stored in the shared folder; the pattern table joined to them
    has at most 3^rules rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "quality-measures")
    docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*").withColumn(
        "votes", F.expr(votes_sql())
    ).write.parquet(path)
    measured = spark.read.parquet(path)
    scores = pattern_posteriors(_counts(measured))
    kept = f"NOT {BASE_FAILED} AND quality_probability >= 0.5"
    return (
        measured.join(F.broadcast(scores), "votes")
        .withColumnRenamed("p_good", "quality_probability")
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", F.expr(kept))
        .drop("votes")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Documents are stored once with their votes: measures cost far more than a copy.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "quality-votes")
    own = [F.col(f"`{c}`") for c in docs.columns]
    measured = docs.select(F.struct(*own).alias("doc"), measures(F.col("text")).alias("m"))
    measured.select("doc", "m.*").select(
        "doc", F.expr(votes_sql()).alias("votes"), F.expr(BASE_FAILED).alias("base_failed")
    ).write.parquet(path)
    voted = spark.read.parquet(path)
    scores = pattern_posteriors(_counts(voted))
    kept = voted.join(F.broadcast(scores), "votes").filter("NOT base_failed AND p_good >= 0.5")
    return kept.select("doc.*")


# The same in DuckDB.
_MEASURES_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_number() OVER () AS rid, doc_id, text,
  list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM
  (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
  len(list_distinct(words))::BIGINT AS n_distinct
  FROM w LEFT JOIN cov USING (rid))"""


def _em_sql() -> str:
    m, k = len(RULES), len(ANCHORS) + 1
    cells = [(c, j) for c in range(k) for j in range(m)]
    rates, shares, limits = start_rates(), start_shares(), rate_limits()
    first = [f"{shares[c]}::DOUBLE AS pi{c}" for c in range(k)]
    first += [f"{rates[c][j]}::DOUBLE AS r{c}_{j}" for c, j in cells]
    ctes = [
        f"v AS (SELECT *, {votes_sql()} AS votes FROM m)",
        "p AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes)",
        f"s0 AS (SELECT {', '.join(first)})",
    ]

    def likelihood(c: int) -> str:
        logs = " + ".join(
            f"CASE substr(votes, {j + 1}, 1) WHEN 'b' THEN ln(r{c}_{j}) WHEN 'g'"
            f" THEN ln(1 - r{c}_{j}) ELSE 0 END"
            for j in range(m)
        )
        return f"exp(ln(pi{c}) + {logs}) AS l{c}"

    def weighted(state: str) -> str:
        total = " + ".join(f"l{c}" for c in range(k))
        return (
            f"SELECT votes, n, {', '.join(f'l{c} / ({total}) AS w{c}' for c in range(k))} FROM"
            f" (SELECT votes, n, {', '.join(map(likelihood, range(k)))} FROM p, {state})"
        )

    for step in range(EM_ROUNDS):
        ctes.append(f"q{step} AS MATERIALIZED ({weighted(f's{step}')})")
        parts = [
            f"(sum(n * w{c}) + {shares[c]} * {PRIOR_WEIGHT}) / (sum(n) + {PRIOR_WEIGHT}) AS pi{c}"
            for c in range(k)
        ]
        for c, j in cells:
            vote = f"substr(votes, {j + 1}, 1)"
            low, high = limits[c][j]
            rate = (
                f"(coalesce(sum(n * w{c}) FILTER ({vote} = 'b'), 0) + {rates[c][j]} * {PRIOR_WEIGHT})"
                f" / (coalesce(sum(n * w{c}) FILTER ({vote} <> '-'), 0) + {PRIOR_WEIGHT})"
            )
            parts.append(f"greatest({low}, least({high}, {rate})) AS r{c}_{j}")
        ctes.append(f"s{step + 1} AS MATERIALIZED (SELECT {', '.join(parts)} FROM q{step})")
    ctes.append(f"f AS (SELECT votes, w0 AS p_good FROM ({weighted(f's{EM_ROUNDS}')}))")
    return ",\n".join(ctes)


ORACLE_CTES = f"{_MEASURES_SQL},\n{_em_sql()}"
ORACLE_SQL = f"""WITH {ORACLE_CTES}
SELECT doc_id, {', '.join(BASE)}, {BASE_FAILED} AS base_failed,
  NOT {BASE_FAILED} AND p_good >= 0.5 AS kept FROM v JOIN f USING (votes)"""
