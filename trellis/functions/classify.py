"""The rule classifier for content, as one native expression without UDFs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    """Phrases with their weights; the rule holds from `least` points on."""

    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    least: int


# Phrases that the rules look for, by weight.
INSIGHT = Signal((
    (2, ("i realized", "i've realized", "the key insight", "what i learned", "what i've learned", "my takeaway", "the main thing", "the important thing", "the crucial",
         "in retrospect", "looking back", "upon reflection", "it dawned on me", "it occurred to me", "it hit me", "the breakthrough", "the aha moment", "eureka",
         "i finally understand", "now i understand", "i get it now", "the lesson here", "the moral", "the conclusion is", "i discovered that", "i've discovered", "i found that",
         "turns out", "it turns out", "as it turns out", "the real issue", "the root cause", "the underlying", "fundamentally", "at its core", "essentially",
         "i was wrong about", "i changed my mind", "i now think")),
    (1, ("understand", "realization", "insight", "learned", "figured out", "makes sense now", "clicked")),
), 3)
DEBUG = Signal((
    (2, ("error:", "error[", "error -", "error!", "error at", "failed:", "failed to", "failure:", "failure at", "exception:", "exception at", "exception in",
         "panic:", "panic at", "panicked at", "stack trace:", "stacktrace:", "backtrace:", "traceback (most recent", "at line ", "on line ", "segmentation fault", "core dumped",
         "unhandled exception", "uncaught exception", "null pointer", "nullpointerexception", "undefined is not", "cannot read property",
         "typeerror:", "referenceerror:", "syntaxerror:", "assertion failed", "assert_eq!", "assert!", "warning:", "warn:", "deprecated:")),
    (1, ("[error]", "[warn]", "[warning]", "[info]", "[debug]", "[trace]", "error  |", "warn  |", "info  |", "level=error", "level=warn")),
), 2)
DEBUG_CODES = ("exit code", "status code", "returned 1")
INVESTIGATION = Signal((
    (2, ("figured out", "found out", "discovered", "realized", "turns out", "it seems", "apparently", "now i understand", "aha", "eureka", "the issue was", "the problem was",
         "root cause", "the fix is", "solution is", "works now", "finally got", "managed to", "succeeded in", "after trying", "after testing", "after debugging",
         "narrowed down", "isolated", "identified")),
    (1, ("let me try", "trying", "testing", "checking", "investigating", "looking into", "digging into", "step 1", "step 2", "next step", "first,", "then,",
         "hypothesis", "theory", "suspect", "might be", "could be", "possibly", "maybe the", "what if")),
), 3)
PROGRESS = ("progress", "update:", "status:")
REFERENCE = Signal((
    (2, ("is defined as", "refers to", "means that", "is a type of", "according to", "wikipedia", "documentation says", "the definition", "officially", "technically speaking",
         "in programming", "in computer science", "in mathematics")),
    (1, ("from the docs", "the manual says", "specification", "rfc ", "standard ", "official ", "source:", "https://", "http://", "www.")),
), 3)
CREATIVE = Signal((
    (3, ("once upon", "in a world", "the story", "chapter ", "*walks", "*looks", "*says", "*thinks", "/me ", "narrator:", "scene:", "act ", "poem:", "verse:", "haiku:", "dear diary", "journal entry")),
), 3)
SYNTHESIS = Signal((
    (3, ("to summarize", "in summary", "overall", "in conclusion", "the key takeaway", "the main point", "putting it together", "combining these", "the pattern is", "what this means is",
         "the bigger picture", "stepping back", "looking at this holistically", "the common thread", "connecting the dots", "the synthesis is")),
), 3)
PLANNING = Signal((
    (2, ("todo", "to-do", "next steps", "action items", "plan is to", "going to", "will need to", "should do", "roadmap", "timeline", "milestone", "phase 1", "phase 2",
         "first we'll", "then we'll", "finally we'll", "the approach", "strategy is", "implementation plan")),
), 3)
QUESTION = Signal((
    (2, ("how does", "why is", "what about", "can you explain", "i'm wondering", "curious about", "help me understand", "what's the difference", "is it possible", "how would")),
), 4)
EXPLORATION = Signal((
    (2, ("what if", "let me try", "i wonder", "maybe", "exploring", "experimenting", "playing with", "not sure yet", "still figuring", "thinking about", "could be", "might work", "let's see",
         "brainstorming", "considering", "pondering", "on one hand", "on the other hand", "alternatively")),
), 4)
TENTATIVE = ("maybe", "might", "could", "perhaps")
TRIVIAL = ("okay", "ok", "thanks", "thank you", "got it", "sure", "yes", "no", "alright", "sounds good", "perfect", "great", "cool", "nice", "understood", "will do", "done", "fixed", "noted")
EXCHANGE = ("human:", "assistant:", "user:", "ai:", "q:", "a:", "question:", "answer:")
CLOSING = ("in summary", "to summarize", "overall", "in conclusion", "the key")
FIRST_PERSON = (" i ", "i'm", "i've", "i'll")
SECOND_PERSON = (" you ", "you're", "you've", "you'll")


def size(text: Column) -> Column:
    return F.octet_length(text)


def times(text: Column, phrase: str) -> Column:
    """Occurrences without overlap."""
    return (size(text) - size(F.replace(text, F.lit(phrase)))) / len(phrase.encode())


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for x in columns[1:]:
        total = total + x
    return total


def points(lower: Column, signal: Signal) -> Column:
    """The weights of the phrases that occur, each once."""

    def weighed(weight: int, phrases: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(lower, p))) * weight

    return _sum([weighed(weight, phrases) for weight, phrases in signal.phrases])


def any_of(lower: Column, phrases: tuple[str, ...]) -> Column:
    found = F.contains(lower, F.lit(phrases[0]))
    for p in phrases[1:]:
        found = found | F.contains(lower, F.lit(p))
    return found


def fenced_bytes(text: Column) -> Column:
    """Bytes inside code fences, a newline for each line; an unclosed fence counts."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n$", ""), "\n")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.trim(line).startswith("```")
        return F.struct((acc["inside"] != fence).alias("inside"), (acc["n"] + F.when(acc["inside"] & ~fence, size(line) + 1).otherwise(0)).cast("long").alias("n"))

    return F.aggregate(lines, start, step, lambda acc: acc["n"])


def rules(text: Column, lower: Column | None = None) -> dict[str, Column]:
    """Each rule of the classifier by name; lower is the text in lower case where that is a column already."""
    lower, n = F.lower(text) if lower is None else lower, size(text)
    marks = times(text, "?")
    count = lambda phrases: _sum([times(lower, p) for p in phrases])
    plain_person = times(lower, " i ") + times(lower, "i'm")
    reference = points(lower, REFERENCE)
    per_kb = F.greatest(n, F.lit(1)) / 1000.0
    return {
        "trivial": (n < 300) & any_of(lower, TRIVIAL) & (marks == 0) & (times(text, ".") + times(text, "!") < 3),
        "conversational": F.contains(text, F.lit("Human:")) | F.contains(text, F.lit("A:")) | (marks >= 2),
        "insight": points(lower, INSIGHT) >= INSIGHT.least,
        "synthesis": points(lower, SYNTHESIS) >= SYNTHESIS.least,
        "planning": points(lower, PLANNING) + F.when(F.contains(lower, F.lit("1.")) & F.contains(lower, F.lit("2.")), 1).otherwise(0) >= PLANNING.least,
        "exploration": points(lower, EXPLORATION) + F.when(count(TENTATIVE) >= 3, 2).otherwise(0) >= EXPLORATION.least,
        "question": ((n < 500) & (marks >= 2)) | (points(lower, QUESTION) >= QUESTION.least),
        "investigation": points(lower, INVESTIGATION) + F.when(any_of(lower, PROGRESS), 1).otherwise(0) >= INVESTIGATION.least,
        "discussion": ((marks / per_kb > 3.0) | (count(EXCHANGE) >= 4)) & ~any_of(lower, CLOSING),
        "reference": reference + F.when((plain_person == 0) & (reference >= 2), 1).otherwise(0) >= REFERENCE.least,
        "creative": points(lower, CREATIVE) + F.when(F.floor(times(text, '"') / 2) >= 4, 2).otherwise(0) + F.when(F.floor(times(text, "*") / 2) >= 3, 2).otherwise(0) >= CREATIVE.least,
        "debug": points(lower, DEBUG) + F.when(any_of(lower, DEBUG_CODES), 1).otherwise(0) >= DEBUG.least,
        "code": (fenced_bytes(text) > 200) & (fenced_bytes(text) / F.greatest(n, F.lit(1)) > 0.4),
        "paste": (n >= 1500) & ((marks + count(FIRST_PERSON) + count(SECOND_PERSON)) / per_kb < 2.0),
    }


def content_type(text: Column, lower: Column | None = None) -> Column:
    """The type of a text: trivial ones first, then conversations by their signals, then the rest."""
    r = rules(text, lower)
    out = F.when((size(text) < 100) | r["trivial"], "trivial")
    for name in ("insight", "synthesis", "planning", "exploration", "question", "investigation", "discussion", "reference", "creative"):
        out = out.when(r["conversational"] & r[name], name)
    for name in ("debug", "code", "paste", "insight", "synthesis"):
        out = out.when(r[name], name)
    return out.otherwise("exploration")


def classified(rows: DataFrame, text: str, into: str = "content_type") -> DataFrame:
    """rows with the type of a text column; its lower case is made once."""
    return rows.withColumn("__lower", F.lower(text)).withColumn(into, content_type(F.col(text), F.col("__lower"))).drop("__lower")


def tier(kind: Column) -> Column:
    from ..model import HIDDEN, SUPPORTING, VISIBLE

    return F.when(kind.isin(*VISIBLE) | kind.rlike("(?i)^code."), "visible").when(kind.isin(*SUPPORTING), "supporting").when(kind.isin(*HIDDEN), "hidden")


# ---- the same for DuckDB


def _sql_text(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _sql_times(text: str, p: str) -> str:
    return f"((strlen({text}) - strlen(replace({text}, {_sql_text(p)}, ''))) / {len(p.encode())})"


def _sql_points(signal: Signal) -> str:
    return "(" + " + ".join(f"{w} * len(list_filter([{', '.join(map(_sql_text, phrases))}], lambda p: contains(l, p)))" for w, phrases in signal.phrases) + ")"


def _sql_any(phrases) -> str:
    return "(" + " OR ".join(f"contains(l, {_sql_text(p)})" for p in phrases) + ")"


def oracle_sql(source: str) -> str:
    """(id, content_type) of the rows (id, t) of a statement."""
    marks = _sql_times("t", "?")
    count = lambda ps: "(" + " + ".join(_sql_times("l", p) for p in ps) + ")"
    ref = _sql_points(REFERENCE)
    rules_ = {
        "insight": f"{_sql_points(INSIGHT)} >= 3", "synthesis": f"{_sql_points(SYNTHESIS)} >= 3",
        "planning": f"{_sql_points(PLANNING)} + (contains(l, '1.') AND contains(l, '2.'))::INT >= 3",
        "exploration": f"{_sql_points(EXPLORATION)} + 2 * ({count(TENTATIVE)} >= 3)::INT >= 4",
        "question": f"((strlen(t) < 500 AND {marks} >= 2) OR {_sql_points(QUESTION)} >= 4)",
        "investigation": f"{_sql_points(INVESTIGATION)} + {_sql_any(PROGRESS)}::INT >= 3",
        "discussion": f"(({marks} / (greatest(strlen(t), 1) / 1000.0) > 3 OR {count(EXCHANGE)} >= 4) AND NOT {_sql_any(CLOSING)})",
        "reference": f"{ref} + ({_sql_times('l', ' i ')} + {_sql_times('l', chr(105) + chr(39) + 'm')} = 0 AND {ref} >= 2)::INT >= 3",
        "creative": f"{_sql_points(CREATIVE)} + 2 * (floor({_sql_times('t', chr(34))} / 2) >= 4)::INT + 2 * (floor({_sql_times('t', '*')} / 2) >= 3)::INT >= 3",
    }
    talk = f"(contains(t, 'Human:') OR contains(t, 'A:') OR {marks} >= 2)"
    debug = f"{_sql_points(DEBUG)} + {_sql_any(DEBUG_CODES)}::INT >= 2"
    paste = f"strlen(t) >= 1500 AND ({marks} + {count(FIRST_PERSON)} + {count(SECOND_PERSON)}) / (strlen(t) / 1000.0) < 2"
    trivial = f"strlen(t) < 100 OR (strlen(t) < 300 AND {_sql_any(TRIVIAL)} AND {marks} = 0 AND {_sql_times('t', '.')} + {_sql_times('t', '!')} < 3)"
    cases = [f"WHEN {trivial} THEN 'trivial'"] + [f"WHEN {talk} AND {rules_[k]} THEN '{k}'" for k in rules_]
    cases += [f"WHEN {debug} THEN 'debug'", f"WHEN {paste} THEN 'paste'", f"WHEN {rules_['insight']} THEN 'insight'", f"WHEN {rules_['synthesis']} THEN 'synthesis'"]
    return f"SELECT id, CASE {' '.join(cases)} ELSE 'exploration' END AS content_type FROM (SELECT id, t, lower(t) AS l FROM ({source}))"
