"""Personal data in texts: e-mail addresses, IP addresses, card and phone numbers.

Base patterns always count. Beyond them, generators of high recall propose spans that may
overlap (number chains, addresses spelt with "(at)"), boosted trees score each proposal for each
kind from its format and context, and a calibrated threshold decides. Chosen spans never touch
a base span or each other.

The trees learn from a sample by kind: at most ``KIND_ROWS`` distinct texts with a base match of
each kind and ``CLEAN_ROWS`` with a digit or an at-sign and no match. Base matches are examples of
their kind, other proposals are counter-examples, and rewritings of base matches (no plus sign,
other separators, "(at)" for "@") stand for what the base patterns miss. Numbers put side by side teach that a run across two of them, or a part of one, is no number.
Thresholds come from a part of the sample the trees did not see. Scoring is one pass without a
shuffle; texts without digits and at-signs are not decoded.

Defined results: a null or empty text has no spans; rows with equal or null ids are judged one
by one; an empty table gives an empty result. Offsets count code points, ends are exclusive.
Only the columns asked for are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlog.llm import text_arrays as ta
from viewlog.llm.boosting import BoostedTrees, calibrate
from viewlog.llm.labelled import thinned
from viewlog.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
KIND_ROWS, CLEAN_ROWS = 1_000, 2_000
MIN_PROBABILITY, CLEAN_QUANTILE = 0.95, 0.999
MAX_VARIANTS, MAX_JOINED = 2_000, 500
JOINED = (2, 2, 2, 2, 3, 3)
JOINTS = (" ", " ", "  ", " / ", " - ")
# An IP address has four digits at least, a card number nineteen at most.
LEAST_DIGITS, MOST_DIGITS, LEAST_LENGTH = 4, 19, 7
BLOCK = 4_096

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits has one way to match, so only its start is tried and nothing is given back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")

_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?|@", re.IGNORECASE)
_SPELT_DOMAIN = re.compile(
    r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)*+", re.IGNORECASE
)
_CHAIN = re.compile(r"[0-9]++(?:[ ().+/-]++[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
# The digit groups beside a span, with nothing but separators between.
_LEFT, _RIGHT = re.compile(r"([0-9]+)[ ().+/-]*$"), re.compile(r"[ ().+/-]*([0-9]+)")
_CONTEXT = [
    re.compile(p, re.IGNORECASE)
    for p in (r"phone|call|tel\b|fax|mobile", r"mail|contact", r"card|visa|credit|pay", r"\bip\b|host|server|addr")
]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and _LOCAL.match(text, at - 1):
        at -= 1
    return at


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost first and apart from each other within a kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        # Local characters hold no at-sign: the first start that can match is the run's own.
        start = _local_start(text, at, end)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match.group().split(".")):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *match.span()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_digits(match.group())) <= 15:
            found.append(("phone", *match.span()))
    return found


def _opening(text: str, begin: int) -> int:
    """Where a number starts whose first digit is at ``begin``: a plus sign and a bracket may open it."""
    for _ in range(2):
        before = text[max(0, begin - 2) : begin]
        if before[-1:] in ("+", "("):
            begin -= 1
        elif before in ("+ ", "( "):
            begin -= 2
    return begin


def proposals(text: str) -> list[tuple[int, int]]:
    """Spans that may be personal data; they may overlap.

    Of a chain of digit groups every run of groups is proposed whose digits may fit a kind. A
    bracket that opens a run and is not closed in it is taken in and left out.
    """
    found = set()
    for match in _CHAIN.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *match.span())]
        for first, (begin, _) in enumerate(groups):
            opened, digits = _opening(text, begin), 0
            bare = opened + 1 if text[opened] == "(" else begin
            # Each group has a digit, so at most MOST_DIGITS runs begin here, however long the chain is.
            for at, stop in groups[first : first + MOST_DIGITS]:
                digits += stop - at
                if digits > MOST_DIGITS:
                    break
                if digits >= LEAST_DIGITS and stop - opened >= LEAST_LENGTH:
                    found.add((opened, stop))
                    if text.find("(", opened, begin) >= 0 > text.find(")", begin, stop):
                        found.add((bare, stop))
    # Local parts and domains of any length: each lies between two neighbouring signs.
    last = 0
    for match in _AT.finditer(text):
        start = _local_start(text, match.start(), last)
        domain = _SPELT_DOMAIN.match(text, match.end())
        if start < match.start() and domain:
            found.add((start, domain.end()))
        last = match.end()
    return sorted(s for s in found if s[1] - s[0] >= 6)


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    left, right = _LEFT.search(before), _RIGHT.match(text[end : end + 24])
    groups = [g.group() for g in _GROUP.finditer(span)]
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    at = _AT.search(span)
    domain = span[at.end() :] if at else ""
    last = re.split(r"[.)\] ]", domain)[-1]
    return [
        len(span),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        span.count(" "),
        span.count("."),
        span.count("-"),
        span.count("/"),
        span.count("(") + span.count(")"),
        span.startswith("+"),
        span.startswith("("),
        13 <= len(digits) <= 19 and luhn(digits),
        bool(groups) and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        at is not None,
        at is not None and at.group() != "@",
        len(re.findall(r"\.|\(dot\)|\[dot\]", domain)),
        len(last) if last.isalpha() else 0,
        sum(c.isalpha() for c in span),
        before[-1:].isalnum() or before[-1:] in ("+", ".", "-", "/", "_") and before != "",
        after[:1].isalnum() or after[:1] in ("-", "/", "_", "@") and after != "",
        before[-1:] in ('"', "'", "=", "#"),
        len(left.group(1)) if left else 0,
        len(right.group(1)) if right else 0,
        *(p.search(before) is not None for p in _CONTEXT),
    ]


def _covered(text: str, spans: list[Span]) -> bytearray:
    """One for each character inside a span, else zero."""
    covered = bytearray(len(text))
    for _, start, end in spans:
        covered[start:end] = b"\1" * (end - start)
    return covered


def _variants(kind: str, span: str, draw: int) -> str:
    """A way to write the same that the base patterns do not see."""
    digits = _digits(span)
    if kind == "phone":
        forms = (span.lstrip("+"), f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}")
        forms += (f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}")
        return forms[draw % 4]
    if kind == "email":
        spelt = span.replace("@", ("(at)", " (at) ", "[at]", " [at] ")[draw % 4])
        return spelt.replace(".", "(dot)") if draw % 8 > 5 else spelt
    if kind == "card":
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return span


class SpanModel:
    """A scorer for each kind, with slope, shift and threshold; kinds without examples add none."""

    def __init__(self):
        self.kinds: dict[str, tuple[BoostedTrees, tuple[float, float], float]] = {}

    def fit(self, texts: list[str]) -> SpanModel:
        rows, kinds, fold = [], [], []
        made, beside, draws = Counter(), ([], []), np.random.default_rng(8)

        def learn(text: str, span: tuple[int, int], kind: str, check: bool) -> None:
            rows.append(features(text, *span))
            kinds.append(kind)
            fold.append(check)

        for number, text in enumerate(texts):
            spans, check = base_spans(text), number % 4 == 0
            base, covered = {(s, e): k for k, s, e in spans}, _covered(text, spans)
            for start, end in sorted(set(proposals(text)) | set(base)):
                kind = base.get((start, end), "")
                if not kind and covered.find(1, start, end) >= 0:  # neither an example nor a counter-example
                    continue
                learn(text, (start, end), kind, check)
                if not kind or sum(made.values()) >= MAX_VARIANTS:
                    continue
                before, after = text[max(0, start - 24) : start], text[end : end + 2]
                other = _variants(kind, text[start:end], made[kind])
                learn(before + other + after, (len(before), len(before) + len(other)), kind, check)
                made[kind] += 1
                if kind == "email" or sum(map(len, beside)) >= MAX_JOINED:
                    continue
                # Numbers side by side: each is an example, every other run of their groups is none.
                line = beside[check]
                line.append((kind, text[start:end]))
                # A plain number has fewer digits than any kind asks for.
                plain = str(draws.integers(10**6, 10**8))
                learn(before + plain + after, (len(before), len(before) + len(plain)), "", check)
                for size in JOINED:
                    own, both, whole = int(draws.integers(size)), before, {}
                    for place in range(size):
                        which, written = line[-1 if place == own else int(draws.integers(len(line)))]
                        if draws.integers(4):
                            written = _variants(which, written, int(draws.integers(8)))
                        both += JOINTS[int(draws.integers(len(JOINTS)))] if place else ""
                        whole[len(both), len(both) + len(written)] = which
                        both += written
                    for span in sorted(set(proposals(both)) | set(whole)):
                        if span[0] >= len(before):
                            learn(both + after, span, whole.get(span, ""), check)
        if not rows:
            return self
        x, check = np.array(rows, float), np.array(fold)
        for kind in KINDS:
            y = np.array([k == kind for k in kinds], float)
            if y[~check].sum() < 5 or y[check].sum() < 2 or (1 - y)[check].sum() < 2 or (1 - y)[~check].sum() < 5:
                continue
            trees = BoostedTrees().fit(x[~check], y[~check])
            score = trees.score(x[check])
            slope, shift = calibrate(score, y[check])
            p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -30, 30)))
            limit = max(MIN_PROBABILITY, float(np.quantile(p[y[check] == 0], CLEAN_QUANTILE)))
            self.kinds[kind] = (trees, (slope, shift), limit)
        return self

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Further spans of the text, best first, apart from base spans and each other."""
        taken = _covered(text, base)
        free = [p for p in proposals(text) if taken.find(1, *p) < 0]
        ranked = []
        for at in range(0, len(free) if self.kinds else 0, BLOCK):
            block = free[at : at + BLOCK]
            x = np.array([features(text, *p) for p in block], float)
            for kind, (trees, (slope, shift), limit) in self.kinds.items():
                logit = slope * trees.score(x) + shift
                p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                ranked += [(-logit[i], block[i], kind) for i in np.flatnonzero(p > limit)]
        chosen: list[Span] = []
        for _, (start, end), kind in sorted(ranked):
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                chosen.append((kind, start, end))
        return chosen


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _telling_rows(column: pa.Array):
    """(row, text) of the rows that can hold a span at all."""
    data, offsets = ta.strings(column)
    telling = ta.byte_class((0x30, 0x39), (0x40, 0x40))
    telling[[ord("("), ord("["), ord("{")]] = True
    marks = np.concatenate([[0], np.cumsum(telling[data])])
    for row in np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]]).tolist():
        yield row, data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")


def sample(docs: DataFrame) -> list[str]:
    """Distinct texts, those with the smallest hashes: ``KIND_ROWS`` with a base match of each kind
    and ``CLEAN_ROWS`` with a digit or an at-sign and no base match."""
    spark = docs.sparkSession
    ta.small_batches(spark)
    rows = docs.select("text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(5), "text").alias("g"))
    rows = rows.filter(F.col("text").rlike("[0-9@]"))

    def marked(batches):
        for batch in batches:
            kinds = np.zeros(batch.num_rows, np.int32)
            for row, text in _telling_rows(batch.column("text")):
                for kind in {k for k, _, _ in base_spans(text)}:
                    kinds[row] |= 1 << KINDS.index(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("g"), pa.array(kinds)], ["h", "g", "kinds"]
            )

    path = scratch_path(spark, "pii-kinds")
    found = rows.mapInArrow(marked, "h bigint, g bigint, kinds int")
    found.groupBy("h", "g").agg(F.max("kinds").alias("kinds")).write.parquet(path)
    stored = spark.read.parquet(path)
    parts = [(F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0, KIND_ROWS) for k in range(len(KINDS))]
    parts.append((F.col("kinds") == 0, CLEAN_ROWS))
    totals = stored.agg(*(F.count_if(has).alias(f"n{i}") for i, (has, _) in enumerate(parts))).first()
    picked = set()
    for (has, wanted), total in zip(parts, totals, strict=True):
        few = stored.filter(has & thinned(F.col("h"), wanted, total)).select("h", "g")
        picked |= {tuple(r) for r in few.orderBy("h", "g").limit(wanted).collect()}
    keys = spark.createDataFrame(sorted(picked), "h bigint, g bigint")
    texts = rows.join(F.broadcast(keys), ["h", "g"]).groupBy("h", "g").agg(F.first("text").alias("text"))
    return [r["text"] for r in sorted(texts.collect(), key=lambda r: (r["h"], r["g"]))]


def fit(docs: DataFrame) -> SpanModel:
    """The model of a bounded sample."""
    return SpanModel().fit(sample(docs))


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def find_personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, base, spans, redacted) of all rows.

    ``doc`` holds the columns named in ``keep`` (default: all). ``base`` and ``spans`` (base and
    added ones) are ordered by kind, then start. ``redacted`` is the text with every span
    replaced by its kind in brackets, null if there is none.
    """
    spark = docs.sparkSession
    ta.small_batches(spark)
    sent = ta.send(spark, fit(docs))
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), "text")
    spans = T.ArrayType(SPAN)
    schema = T.StructType(
        [rows.schema["doc"], T.StructField("base", spans), T.StructField("spans", spans)]
        + [T.StructField("redacted", T.StringType())]
    )
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches):
        model = ta.received(sent)
        for batch in batches:
            base: list[list] = [[] for _ in range(batch.num_rows)]
            every, redacted = [[] for _ in base], [None] * len(base)
            for row, text in _telling_rows(batch.column("text")):
                base[row] = in_order(base_spans(text))
                every[row] = in_order(base[row] + model.added(text, base[row]))
                if every[row]:
                    redacted[row] = redact(text, every[row])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    *(pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r] for r in spans], span_type) for spans in (base, every)),
                    pa.array(redacted, pa.string()),
                ],
                ["doc", "base", "spans", "redacted"],
            )

    return rows.mapInArrow(found, schema)


def redact(text: str, spans: list[Span]) -> str:
    """Replace spans by their kinds; overlapping base spans of two kinds go together."""
    pieces, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            pieces += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])
