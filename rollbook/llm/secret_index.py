"""Secret scans through a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import named, staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of ``pattern`` are leftmost and do not overlap; those whose ``group`` has fewer
    than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed values of the contract: base kinds in their order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Kinds that the scan adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
)

#: Strings that one stretch of a pattern may be spelled in, before it is given up as a source of trigrams.
SPELLINGS = 64


def _ascii_lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


class _Needs:
    """What every match of the parts read so far holds: clauses that a text must all satisfy, and the strings in
    which the stretch at the end may be spelled."""

    def __init__(self) -> None:
        self.clauses: list[list[list[str]]] = []
        self.open = {""}
        #: whether the open strings spell all that was read
        self.whole = True

    def close(self) -> None:
        """End the stretch. A branch that asks for more than another adds nothing."""
        grams = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in self.open}
        if all(grams):
            self.clauses.append(sorted(sorted(g) for g in grams if not any(h < g for h in grams)))
        self.open, self.whole = {""}, False

    def follow(self, spellings: set[str] | None) -> None:
        """Go on with one of ``spellings``; with anything, for None."""
        longer = {a + b for a in self.open for b in spellings} if spellings is not None else set()
        if 0 < len(longer) <= SPELLINGS:
            self.open = longer
        else:
            self.close()

    def read(self, parts) -> None:
        for op, value in parts:
            name = str(op)
            if name == "AT":
                continue
            if name == "LITERAL":
                self.follow({_ascii_lower(chr(value))})
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
                self.follow({_ascii_lower(chr(c)) for _, c in value})
            elif name == "SUBPATTERN":
                self.read(value[-1])
            elif name == "BRANCH":
                self._either([_needs(x) for x in value[1]])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
                inner = _needs(value[2])
                self.follow(inner.open | {""} if not inner.clauses and value[0] == 0 and inner.whole else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                self.read(value[2])
                self.close()
            else:
                self.close()

    def _either(self, branches: list[_Needs]) -> None:
        if all(b.whole and not b.clauses for b in branches):
            self.follow(set().union(*(b.open for b in branches)))
            return
        self.close()
        for b in branches:
            b.close()
        if all(b.clauses for b in branches):  # one clause of each branch: the one with most trigrams
            best = [max(b.clauses, key=lambda c: min(map(len, c))) for b in branches]
            self.clauses.append([grams for clause in best for grams in clause])


def _needs(parts) -> _Needs:
    out = _Needs()
    out.read(parts)
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """The Boolean query of a regular expression: a text with a match satisfies every clause, that is, holds all
    trigrams (in lower case) of at least one of its branches. No clause: no trigram is mandatory."""
    needs = _needs(_parser.parse(pattern))
    needs.close()
    return needs.clauses


def postings(docs: DataFrame, grams: Sequence[str], *, key: str, text: str) -> DataFrame:
    """``gram``, ``doc``: the inverted index of these trigrams over lower-cased texts, a row per distinct pair.

    Lower case of other than ASCII letters may add a posting, never lose one.
    """
    # one exploded element each: a plan step, so that a text is lower-cased once and not for every trigram
    low = docs.select(named(key).alias("doc"), F.explode(F.array(F.lower(named(text)))).alias("low"))
    held = F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams))
    return low.select("doc", F.explode(held).alias("gram")).where("gram IS NOT NULL").distinct()


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc``, ``kinds``: the rules with a Boolean query that a document's postings satisfy."""
    spark = index.sparkSession
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    wanted = [
        (kind, c, f"{c}/{b}", gram, len(grams), len(clauses))
        for kind, clauses in queries.items() for c, clause in enumerate(clauses) for b, grams in enumerate(clause) for gram in grams
    ]
    # a few rows per rule, whatever the data
    terms = F.broadcast(spark.createDataFrame(wanted, "kind string, clause int, branch string, gram string, needed int, clauses int"))
    met = index.join(terms, "gram").groupBy("doc", "kind", "clauses", "clause", "branch", "needed").agg(F.count("*").alias("found"))
    met = met.where("found = needed").groupBy("doc", "kind", "clauses").agg(F.count_distinct("clause").alias("met"))
    return met.where("met = clauses").groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


_SPANS = "array<struct<start:int,kind:string,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, rule: Rule, step: int = 512) -> Column:
    """Array of (start, kind, end) of the rule's matches, by code points, end exclusive.

    The pieces between matches and the matches alternate, so running sums of their lengths are the places. They are summed
    in stretches of ``step`` matches, then over the stretches: adding to an array copies it, so one sum over n matches
    would take n * n steps.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    parts = F.arrays_zip(hits.alias("hit"), groups.alias("group"), F.split(text, rule.pattern, -1).alias("gap"))
    sizes = F.transform(parts, lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["group"]) >= rule.least).alias("good")
    ))
    none = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))  # the last piece has no match behind it
        span = F.struct(begin.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.when(x["good"], F.array(span)).otherwise(none)).alias("out"))

    def stretches(sizes: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(step))
        return F.transform(firsts, lambda at: F.aggregate(F.slice(sizes, at + 1, F.lit(step)), start, add))

    def placed(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda sums, p: F.concat(sums, F.array(F.element_at(sums, -1) + p["at"])))
        both = F.arrays_zip(parts.alias("part"), before.alias("before"))
        return F.flatten(F.transform(F.filter(both, lambda b: b["part"].isNotNull()), lambda b: F.transform(b["part"]["out"], lambda s: F.struct(
            (s["start"] + b["before"]).alias("start"), s["kind"].alias("kind"), (s["end"] + b["before"]).alias("end")
        ))))

    return _let(_let(sizes, stretches), placed)


def _found(text: Column, rule: Rule, maybe: Column) -> Column:
    none = F.array().cast(_SPANS)
    return F.when(maybe & text.rlike(rule.pattern), spans(text, rule)).otherwise(none)


def _joined(all_spans: Column, rules: Sequence[Rule]) -> Column:
    """``kind:start:end`` of the spans by start, then kind as listed, comma-joined."""
    order = F.create_map(*(F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)))
    keyed = F.transform(all_spans, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("b"), s["kind"].alias("k"), s["end"].alias("e")))
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["e"].cast("string"))), ","
    )


def scan(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", base: Sequence[Rule] = BASE_RULES, more: Sequence[Rule] = MORE_RULES
) -> DataFrame:
    """One row per document: ``key``, ``n_<kind>`` of each base rule, ``base`` and ``spans`` (joined texts).

    Rules with mandatory trigrams are verified only on the documents that the index gives for them; the others
    read every text. Candidates belong to keys: all rows of a repeated key, null included, are verified. A null
    text is empty. Spans of different kinds may overlap, and all stay. Texts may be of any length, with any number of
    matches. Other columns are dropped; an empty table gives an empty one.
    """
    rules = [*base, *more]
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for query in queries.values() for clause in query for branch in clause for g in branch})
    maybe = candidates(staged(postings(docs, grams, key=key, text=text), "postings"), rules) if grams else None
    rows = docs.select(named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("t"))
    if maybe is not None:
        maybe = staged(maybe, "candidates")
        rows = rows.join(maybe, F.col("k").eqNullSafe(F.col("doc")), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    t = F.col("t")
    for r in rules:
        listed = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if queries[r.kind] else F.lit(True)
        rows = rows.withColumn(f"s_{r.kind}", _found(t, r, listed))
    every = [F.col(f"s_{r.kind}") for r in rules]
    return rows.select(
        F.col("k").alias(key), *(F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base),
        _joined(F.concat(*every[: len(base)]), base).alias("base"), _joined(F.concat(*every), rules).alias("spans"),
    )
