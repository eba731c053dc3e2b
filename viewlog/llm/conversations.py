"""Repair of the structure of conversations by an auction shortest-path algorithm.

The rows of a conversation are read in order; a state says what was put out last (nothing, a
system, user or assistant turn). A node of the lattice is a place between two rows with a state,
an arc is an edit: keep a row (0), give it the role that is due (1), delete it (2), or insert an
empty turn of the due role (5); a truncated row that stays costs 5 more, and blank rows and
repeats can only go. The cheapest path to a legal end is the cheapest repair.

Nodes have integer prices, at first 0, none above the cost of an arc plus the price at its end.
A path grows from the origin by the arc that attains this bound; where none does, the price of
its last node rises to it and the path is cut back by one arc. When the path arrives, the price
of the origin is its distance, and every arc of every shortest path is tight (price = cost + next
price). The path with the least letters is traced over the tight arcs from which the end can be
reached by tight arcs. Blocks of rows are auctioned from the last to the first, from each state,
with the prices behind a block already settled, so work is in proportion to the rows.

Conversations are counted first. Those of up to ``LONG_ROWS`` rows and ``LONG_CHARS`` characters
are sorted and repaired in one pass. Longer ones take another way with the same results: their
rows are dealt by place and text, so no task holds one; codes alone are brought together, a byte
a row, as the audit in the result has a letter a row; and the repaired lines stream through the
digest of the conversation, which no two tasks can share.

Defined results: a null role or text is one space, as are null parts of the key that chooses the
damage; null turns come first and count in no gap; a null conv_id is a conversation of its own.
Rows of one turn are ordered by role, text and copy. Role initials are first characters, so an
empty role has none and is never legal. An empty table has no row; columns other than the four
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.llm.ranks import ranked
from viewlog.session import scratch_path

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LONG_ROWS, LONG_CHARS = 4096, 8 << 20
BLOCK = 32
KNOWN = 100_000  # solved codes that a task keeps
SPACE = " \t\n\v\f\r"
ENDS = ".!?"

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
# A row as one character: its initial (o: another), a capital if truncated; x if it must go.
MUST_GO = "x"

RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def arcs(code: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows taken, next state) of a place before the row ``code`` (None: the end)."""
    found = []
    if code is not None:
        found.append(("D", DELETE, 1, state))
    found.append(("I", INSERT, 0, DUE[state]))
    if code is not None and code != MUST_GO:
        more = TRUNCATED if code.isupper() else 0
        role = BY_INITIAL.get(code.lower())
        if role == DUE[state] or (role == SYSTEM and state == START):
            found.append(("K", KEEP + more, 1, role))
        found.append(("R", REROLE + more, 1, DUE[state]))
    return found


class Lattice:
    """Prices of the nodes (place, state) of one conversation."""

    def __init__(self, codes: str):
        self.codes, self.n = codes, len(codes)
        self.price = [[0, 0, 0, 0] for _ in range(self.n + 1)]
        for low in range(max(0, (self.n - 1) // BLOCK) * BLOCK, -1, -BLOCK):
            high = min(low + BLOCK, self.n)
            for state in (START,) if low == 0 else range(4):
                self._auction(low, state, high)

    def _out(self, i: int, state: int):
        return arcs(self.codes[i] if i < self.n else None, state)

    def _settled(self, i: int, state: int, high: int) -> bool:
        return i == high and (high < self.n or state in (START, ASSISTANT))

    def _auction(self, low: int, origin: int, high: int) -> None:
        price, path = self.price, [(low, origin)]
        while not self._settled(*path[-1], high):
            i, state = path[-1]
            least, way = min((cost + price[i + took][after], (i + took, after)) for _, cost, took, after in self._out(i, state))
            if price[i][state] < least:
                price[i][state] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(way)

    def trace(self) -> tuple[int, str]:
        """Cost and the least letters of a cheapest repair."""
        letters, i, state = [], 0, START
        while True:
            high = min(self.n, i // BLOCK * BLOCK + BLOCK)
            reached: dict[tuple[int, int], bool] = {}
            while not self._settled(i, state, high):
                letter, i, state = min(
                    (letter, *way) for letter, way in self._tight(i, state) if self._leads(*way, high, reached)
                )
                letters.append(letter)
            if high == self.n:
                return self.price[0][START], "".join(letters)

    def _tight(self, i: int, state: int):
        for letter, cost, took, after in self._out(i, state):
            if self.price[i][state] == cost + self.price[i + took][after]:
                yield letter, (i + took, after)

    def _leads(self, i: int, state: int, high: int, reached: dict) -> bool:
        """Whether tight arcs lead on to a settled node; prices fall or places rise, so it ends."""
        if self._settled(i, state, high):
            return True
        if (i, state) not in reached:
            reached[i, state] = any(self._leads(*way, high, reached) for _, way in self._tight(i, state))
        return reached[i, state]


def solve(codes: str, known: dict[str, tuple[int, str]] | None = None) -> tuple[int, str]:
    """Cost and audit; short conversations of equal codes are solved once a task (``known``)."""
    if known is None or len(codes) > BLOCK:
        return Lattice(codes).trace()
    if codes not in known:
        if len(known) >= KNOWN:
            known.clear()
        known[codes] = Lattice(codes).trace()
    return known[codes]


def edits(audit: str, codes: str) -> Iterator[tuple[int | None, str | None]]:
    """(row or None, role or None for its own) of each turn of the repaired conversation."""
    row, state = 0, START
    for letter in audit:
        if letter == "I":
            state = DUE[state]
            yield None, ROLES[state]
            continue
        if letter == "K":
            state = BY_INITIAL[codes[row].lower()]
            yield row, None
        elif letter == "R":
            state = DUE[state]
            yield row, ROLES[state]
        row += 1


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage, and the dropped ones marked ``gone`` (their conversation stays)."""
    given = rows.select(F.struct("conv_id", "turn", "role", "text").alias("r"))

    def said(name: str) -> Column:
        return F.coalesce(F.col(f"r.{name}").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    made = given.select(
        F.col("r.conv_id").cast("bigint").alias("conv_id"),
        F.col("r.turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        F.when(kind != 0, text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return made


class Conversation:
    """One conversation as its rows arrive in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.rows: list[tuple[int | None, str, str]] = []

    def result(self, known: dict[str, tuple[int, str]]) -> tuple:
        codes, counts, seen = [], [0, 0, 0], set()
        for _, role, text in self.rows:
            body, first = text.strip(SPACE), role[:1] if role[:1] in BY_INITIAL else "o"
            if not body:
                counts[0] += 1
                first = MUST_GO
            elif (role, text) in seen:
                counts[1] += 1
                first = MUST_GO
            elif body[-1] not in ENDS:
                counts[2] += 1
                first = first.upper()
            seen.add((role, text))
            codes.append(first)
        turns = {t for t, _, _ in self.rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = "".join([role[:1] if role[:1] in BY_INITIAL else "o" for _, role, _ in self.rows])
        cost, audit = solve("".join(codes), known)
        lines = [
            f"{self.rows[row][1] if role is None else role}:{'' if row is None else self.rows[row][2]}"
            for row, role in edits(audit, "".join(codes))
        ]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        return (self.conv_id, gaps, *counts, illegal(initials), cost, audit, digest)


def _arrow_schema(df_schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in df_schema.split(", "))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def long_ones(rows: DataFrame) -> DataFrame:
    """Ids of the conversations that no task should hold: one row each, reduced where they are read."""
    chars = F.sum(F.length("text") + F.length("role"))
    sizes = rows.groupBy(F.col("conv_id").cast("bigint").alias("long_id")).agg(F.count("*").alias("n"), chars.alias("chars"))
    return sizes.filter((F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)).select("long_id")


def repair(rows: DataFrame) -> DataFrame:
    """Every conversation's faults, cost, audit and the digest of its repaired form."""
    spark = rows.sparkSession
    ta.small_batches(spark)
    rows = rows.select("conv_id", "turn", "role", "text")
    path = scratch_path(spark, "long-ones")
    long_ones(rows).write.parquet(path)
    long, found = spark.read.schema("long_id bigint").parquet(path), damaged(rows)
    if long.isEmpty():
        return _repair_short(found)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _repair_short(found.join(long, is_long, "left_anti"))
    return short.unionByName(_repair_long(found.join(long, is_long, "left_semi"), long))


def _repair_short(found: DataFrame) -> DataFrame:
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    schema = _arrow_schema(RESULT)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, known = None, [], {}
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")]
            for conv_id, turn, role, text, gone in zip(*columns, strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        out.append(current.result(known))
                    current = Conversation(conv_id)
                if not gone:
                    current.rows.append((turn, role, text))
            if len(out) >= ta.BATCH_ROWS:
                yield _table(out, schema)
                out = []
        if current is not None:
            out.append(current.result(known))
        if out:
            yield _table(out, schema)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(repaired, RESULT)


def _repair_long(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for conversations that no task should hold: rows are dealt by their place."""
    spark, base = rows.sparkSession, scratch_path(rows.sparkSession, "long-conversations")
    rows = rows.filter("NOT gone").drop("gone")
    rows.write.parquet(f"{base}/rows")
    rows = ranked(spark.read.schema(rows.schema).parquet(f"{base}/rows"), ["conv_id"], ["turn", "role", "text", "copy"])
    body = F.expr(r"trim(BOTH ' \t\n\u000b\f\r' FROM text)")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns(
        {"is_blank": body == "", "last": F.right(body, F.lit(1)), "initial": F.when(initial.isin(*BY_INITIAL), initial).otherwise("o")}
    )
    rows.write.parquet(f"{base}/placed")
    rows = spark.read.parquet(f"{base}/placed")
    # The first row of each (role, text); joined by place, so that no text is a hot key.
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("index").alias("first_index"))
    firsts = firsts.select(F.col("conv_id").alias("first_conv"), "first_index")
    same = F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("index") == F.col("first_index"))
    marked = rows.join(firsts, same, "left").withColumn("repeated", ~F.col("is_blank") & F.col("first_index").isNull())
    cut = ~F.col("is_blank") & ~F.col("repeated") & ~F.col("last").isin(*ENDS)
    code = F.when(F.col("is_blank") | F.col("repeated"), MUST_GO).when(cut, F.upper("initial")).otherwise(F.col("initial"))
    coded = marked.select("conv_id", "index", "turn", "initial", "is_blank", "repeated", cut.alias("cut"), code.alias("code"))
    coded.write.parquet(f"{base}/codes")
    coded = spark.read.parquet(f"{base}/codes")
    counts = coded.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.count_if("is_blank").alias("blank"),
        F.count_if("repeated").alias("duplicate"),
        F.count_if("cut").alias("truncated"),
    )

    def together(by: list, entry: list, parts: list[str]) -> DataFrame:
        made = F.sort_array(F.collect_list(F.struct(*entry))).alias("e")
        return lambda df: df.groupBy(*by).agg(made).select(*by, *[F.array_join(F.col(f"e.{p}"), "").alias(p) for p in parts])

    blocks = together(["conv_id", "block"], ["index", "code", "initial"], ["code", "initial"])(
        coded.withColumn("block", F.floor(F.col("index") / LONG_ROWS))
    )
    whole = together(["conv_id"], ["block", "code", "initial"], ["code", "initial"])(blocks)
    schema = "conv_id bigint, illegal bigint, cost bigint, audit string, code string"

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = (row["conv_id"], illegal(row["initial"]), *solve(row["code"]), row["code"])
                yield _table([out], _arrow_schema(schema))

    whole.mapInArrow(solved, schema).write.parquet(f"{base}/audits")
    audits = spark.read.schema(schema).parquet(f"{base}/audits")
    turns = "own_id bigint, place bigint, row bigint, role_now string"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv in b.to_pylist():
                out = []
                for place, (row, role) in enumerate(edits(conv["audit"], conv["code"])):
                    out.append((conv["conv_id"], place, row, role))
                    if len(out) == LONG_ROWS:
                        yield _table(out, _arrow_schema(turns))
                        out = []
                if out:
                    yield _table(out, _arrow_schema(turns))

    kept = audits.mapInArrow(listed, turns)
    here = F.col("own_id").eqNullSafe(F.col("conv_id")) & (F.col("row") == F.col("index"))
    line = F.concat(F.coalesce("role_now", "role"), F.lit(":"), F.coalesce("text", F.lit("")))
    lines = kept.join(rows.select("conv_id", "index", "role", "text"), here, "left").select("own_id", "place", line.alias("line"))
    hashed_schema = "own_id bigint, repaired_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        schema = _arrow_schema(hashed_schema)
        for b in batches:
            for own, place, text in zip(*[b.column(c).to_pylist() for c in ("own_id", "place", "line")], strict=True):
                if place == 0:
                    if state is not None:
                        yield _table([(current, state.hexdigest())], schema)
                    current, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
        if state is not None:
            yield _table([(current, state.hexdigest())], schema)

    digests = lines.repartition("own_id").sortWithinPartitions("own_id", "place").mapInArrow(hashed, hashed_schema)
    result = audits.drop("code").join(counts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    result = result.join(digests, F.col("conv_id").eqNullSafe(F.col("own_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    result = ids.join(result.drop("c", "own_id"), F.col("long_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    result = result.withColumnRenamed("long_id", "conv_id").fillna({"audit": "", "repaired_sha256": nothing})
    names = _arrow_schema(RESULT).names
    return result.fillna(0, [n for n in names if n != "conv_id"]).select(*names)


def _added(cost: int | str, letters: str, best: str) -> str:
    return f"printf('%09d', CAST(substr({best}, 1, 9) AS BIGINT) + {cost}) || '{letters}' || substr({best}, 10)"


def _step(state: int) -> str:
    """SQL of the cheapest repair from a state on that takes a row first: cost and letters as one text."""
    name, due = "bsua"[state], "bsua"[DUE[state]]
    kept = f"initial = '{due}' THEN {_added('more', 'K', 'n' + due)}"
    if state == START:
        kept += f" WHEN initial = 's' THEN {_added('more', 'K', 'ns')}"
    stays = f"CASE WHEN gone THEN NULL WHEN {kept} END"
    moved = f"CASE WHEN NOT gone THEN {_added('1 + more', 'R', 'n' + due)} END"
    return f"least({_added(2, 'D', 'n' + name)}, {stays}, {moved}) AS c{name}"


ORACLE_SQL = f"""
WITH RECURSIVE given AS MATERIALIZED (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
codes AS (
  SELECT key, [ascii(substr(key, i, 1)) FOR i IN range(1, length(key) + 1)] AS bytes
  FROM (SELECT DISTINCT key FROM given)),
crc AS (
  SELECT key, bytes, 0 AS step, 4294967295::BIGINT AS c FROM codes
  UNION ALL
  SELECT key, bytes, step + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(c, bytes[step // 8 + 1]::BIGINT) ELSE c END AS x FROM crc
        WHERE step < 8 * len(bytes))),
kinds AS (SELECT key, xor(c, 4294967295::BIGINT) % 20 AS kind FROM crc WHERE step = 8 * len(bytes)),
after_damage AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given JOIN kinds USING (key) WHERE kind <> 0),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos, substr(role, 1, 1) AS initial,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM after_damage),
faults AS MATERIALIZED (
  SELECT *, body = '' AS blank, body <> '' AND repeat_no > 1 AS duplicate,
    body <> '' AND repeat_no = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) AS repeat_no FROM placed)),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv),
best AS (
  SELECT conv, n AS pos, '000000000' AS nb, '000000010II' AS ns, '000000005I' AS nu, '000000000' AS na FROM counts
  UNION ALL
  SELECT conv, pos - 1, least(cb, {_added(5, 'I', 'cu')}, {_added(10, 'II', 'ca')}),
    least(cs, {_added(5, 'I', 'cu')}, {_added(10, 'II', 'ca')}), least(cu, {_added(5, 'I', 'ca')}), least(ca, {_added(5, 'I', 'cu')})
  FROM (
    SELECT conv, pos, {_step(START)}, {_step(SYSTEM)}, {_step(USER)}, {_step(ASSISTANT)}
    FROM (SELECT b.*, f.initial, f.blank OR f.duplicate AS gone, CASE WHEN f.truncated THEN 5 ELSE 0 END AS more
          FROM best b JOIN faults f ON f.conv = b.conv AND f.pos = b.pos))),
audits AS MATERIALIZED (
  SELECT conv, CAST(substr(nb, 1, 9) AS BIGINT) AS cost, substr(nb, 10) AS audit FROM best WHERE pos = 0),
walk AS (
  SELECT conv, audit, 0 AS k, 1 AS pos, 'user' AS due, '' AS out FROM audits
  UNION ALL
  SELECT w.conv, audit, k + 1, CASE WHEN letter = 'I' THEN w.pos ELSE w.pos + 1 END,
    CASE WHEN letter = 'D' THEN due WHEN letter = 'K' THEN CASE WHEN f.initial = 'u' THEN 'assistant' ELSE 'user' END
      WHEN due = 'user' THEN 'assistant' ELSE 'user' END,
    CASE WHEN letter = 'D' THEN out ELSE out || chr(10) || CASE letter WHEN 'K' THEN f.role || ':' || f.text
      WHEN 'R' THEN due || ':' || f.text ELSE due || ':' END END
  FROM (SELECT *, substr(audit, k + 1, 1) AS letter FROM walk WHERE k < length(audit)) w
  LEFT JOIN faults f ON f.conv = w.conv AND f.pos = w.pos),
repaired AS (SELECT conv, substr(out, 2) AS out FROM walk WHERE k = length(audit))
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM given) g LEFT JOIN counts USING (conv) LEFT JOIN audits USING (conv)
LEFT JOIN repaired USING (conv)
"""
