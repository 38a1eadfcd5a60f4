"""Secret scan with DataFrame functions only: fixed patterns, plus strings that look random.

Positions come from splitting the text around the matches of a pattern: the lengths of the parts between
them and of the matches, summed up, are the starts.

Random strings are told from ordinary identifiers by two character Markov models: one of the values that the
patterns found (labelled random), one of ordinary words.  Each model is a table of transition counts; a
candidate's score is the mean log-likelihood ratio of its transitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_only
from .fingerprints import once

# The three base patterns, and what of a match is kept.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a match of AKIA[A-Z0-9]+ with 16 characters or more
HEX = r"[0-9a-f]{32,}"  # a match of [0-9a-f]+ with 32 characters or more
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
# Transitions are between characters of codes LOW to HIGH; others never occur in a candidate.
LOW, HIGH = 43, 122
SIDE = HIGH - LOW + 1


def spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    ``keep`` filters by the matched text after the matches are placed.  Without a match nothing is split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), placed(found, F.split(text, pattern, -1), keep)).otherwise(no_spans())


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")


BLOCK = 256


def blocks(items: Column) -> Column:
    """``items`` in runs of BLOCK: work that copies what it has so far does so within a run, not over a whole text."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda at: F.slice(items, at, BLOCK))


def running(items: Column, value, join) -> Column:
    """For each run of ``items`` the pair (run, what ``join`` makes of the values of all runs before it; 0 before the first).

    ``value`` maps a run to an int.
    """
    def carried(runs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        before = F.aggregate(
            F.transform(runs, value), start,
            lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.zip_with(runs, before, lambda run, at: F.struct(run.alias("run"), at.alias("at")))

    return once(blocks(items), carried)


def placed(found: Column, between: Column, keep) -> Column:
    """Spans of the matches ``found`` from the text ``between`` them: lengths summed up, run by run."""
    sized = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("value")))
    total = lambda run: F.aggregate(run, F.lit(0), lambda s, x: s + x["gap"] + x["n"])

    def walk(x: Column) -> Column:
        start = F.struct(x["at"].alias("at"), no_spans().alias("out"))
        return F.aggregate(
            x["run"], start,
            lambda acc, y: F.struct(
                (acc["at"] + y["gap"] + y["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + y["gap"]).alias("start"), (acc["at"] + y["gap"] + y["n"]).alias("end"), y["value"].alias("value")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    walked = F.flatten(F.transform(running(sized, total, lambda a, b: a + b), walk))
    return F.filter(walked, lambda s: keep(s["value"])) if keep else walked


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text and the spans of each base pattern: assign, access, hex."""
    t = F.col("text")
    return text_only(docs, text=text).select(
        "doc_id", "text",
        spans(t, ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8).alias("assign"),
        spans(t, ACCESS).alias("access"),
        spans(t, HEX).alias("hex"),
    )


def transitions(value: Column) -> Column:
    """array<int>: a code for each pair of neighbouring characters of a candidate."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - LOW)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * SIDE + b)


def counts_of(values: DataFrame) -> dict[int, int]:
    """Transition counts of column ``value``; at most SIDE * SIDE rows reach the driver."""
    once = values.filter(f"value rlike '^[{chr(LOW)}-{chr(HIGH)}]{{2,}}$'").groupBy("value").agg(F.count("*").alias("n"))
    pairs = once.select("n", F.explode(transitions(F.col("value"))).alias("p"))
    return {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()}


def log_ratios(random: dict[int, int], ordinary: dict[int, int], smooth: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) by transition code, smoothed over the alphabet that occurs."""
    size = max(2, len({p % SIDE for p in [*random, *ordinary]} | {p // SIDE for p in [*random, *ordinary]}))
    out = []
    for p in range(SIDE * SIDE):
        row = range(p // SIDE * SIDE, (p // SIDE + 1) * SIDE)
        logs = [math.log((m.get(p, 0) + smooth) / (sum(m.get(q, 0) for q in row) + smooth * size)) for m in (random, ordinary)]
        out.append(round(logs[0] - logs[1], 6))
    return out


# Words of letters, joining marks and short numbers.  The possessive repetitions keep the matcher from recursing, so a
# word may be as long as the text.
ORDINARY = r"\b[A-Za-z]++(?:[_-]?[A-Za-z]++|[_-]?[0-9]{1,4}+)*+\b"


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """The log-ratio table, counted over all documents.

    Labelled random: the values that the base patterns found.  Labelled ordinary: the words (ORDINARY) of four
    characters or more.  Distinct values are counted first, then their transitions, so at most SIDE * SIDE numbers
    reach the driver, whatever the table holds.
    """
    rows = base_spans(docs, text)
    values = F.concat(F.transform("assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2)), F.transform("access", lambda s: s["value"]), F.transform("hex", lambda s: s["value"]))
    random = counts_of(rows.select(F.explode(values).alias("value")))
    words = F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))
    ordinary = counts_of(text_only(docs, text=text).select(F.explode(words).alias("value")).filter("length(value) >= 4"))
    return log_ratios(random, ordinary)


def scan(docs: DataFrame, ratios: list[float], threshold: float = 0.0, text: str = "text") -> DataFrame:
    """doc_id, text and found: array<struct<start, end, kind, value>> by start, then kind as in KINDS.

    Kind random: candidates (CANDIDATE) with a digit and a letter that touch no base span, with a mean log-ratio of
    ``threshold`` or more, as a whole and (from six letters on) of their letters alone.  Null text is empty and has no spans; a null doc_id stays null; repeated rows are
    scanned one by one; an empty table gives no row; columns other than doc_id and the text are not read.
    """
    rows = base_spans(docs, text)
    table = F.from_json(F.lit(str(ratios)), "array<double>")  # folded to one constant of SIDE * SIDE numbers
    steps = lambda v: F.aggregate(transitions(v), F.lit(0.0), lambda s, p: s + F.get(table, p))
    # numbers inside a name are common; what tells is whether its letters follow each other like letters of words
    letters = lambda v: F.regexp_replace(v, "[^A-Za-z]+", "")
    spelled = lambda v: (F.length(letters(v)) < 6) | (steps(letters(v)) / (F.length(letters(v)) - 1) >= threshold)
    looks = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (steps(v) / (F.length(v) - 1) >= threshold) & spelled(v)
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("candidates", spans(F.col("text"), CANDIDATE, lambda v: v.rlike("[0-9]")))
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])) & looks(c["value"]))
    rows = rows.withColumn("random", free)
    tagged = [ranked(kind, i) for i, kind in enumerate(KINDS)]
    names = F.array(*map(F.lit, KINDS))
    found = F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["rank"]).alias("kind"), s["value"].alias("value")))
    return rows.select("doc_id", "text", found.alias("found"))


def ranked(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans, from ``scan``'s rows."""
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return scanned.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), n("random"),
    )


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """doc_id and the text with every span (overlapping ones as one) replaced by ``mark``."""
    text, ends = F.col("text"), lambda run: F.array_max(F.transform(run, lambda s: s["end"]))

    def cut(x: Column) -> Column:
        """The run's pieces of text before its spans, each with a mark after it; ``x.at`` is where the text before it ended."""
        first, last = x["at"], F.get(x["run"], F.size(x["run"]) - 1)["start"]
        start = F.struct(first.alias("at"), F.lit("").alias("out"))

        def piece(acc, s, part):
            later = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
            shown = F.concat(acc["out"], F.substring(part, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.when(s["start"] < acc["at"], later).otherwise(F.struct(s["end"].alias("at"), shown.alias("out")))

        part = F.substring(text, first + 1, F.greatest(last - first, F.lit(0)))
        return once(part, lambda p: F.aggregate(x["run"], start, lambda acc, s: piece(acc, s, p), lambda acc: acc["out"]))

    marked = F.array_join(F.transform(running(F.col("found"), ends, F.greatest), cut), "")
    rest = F.substring(text, ends(F.col("found")) + 1, F.length("text"))
    return scanned.select("doc_id", F.when(F.size("found") > 0, F.concat(marked, rest)).otherwise(text).alias("text"))
