"""Secret scans with DataFrame functions only.

Base spans are pattern matches: assignments of a value to a secret-like name, access key ids, and
long hexadecimal runs.  Entropy spans come from a window that slides over each candidate string:
the Shannon entropy of the window follows from counts per character that change by one character
in and one out at each step.  Every character class has its own window and threshold, and an
allow-list suppresses candidates that are known to be harmless; it never removes base spans.

Spans are code point ranges, end exclusive.  Null and empty texts have none.  Each row is scanned
on its own, so repeated rows give repeated results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .batches import free_name

# Base patterns.  Of the last two only matches of the least length count, so the
# pattern asks for it at once: a run that is too short has no longer match inside it.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

#: Steps of the entropy sums: they are integers in millionths of a bit, so every engine gets the same.
MICRO = 1_000_000


@dataclass(frozen=True)
class CharClass:
    """Candidates are whole runs of ``alphabet`` that also match ``needs``; a window counts from ``bits`` of entropy on."""

    kind: str
    alphabet: str
    needs: tuple[str, ...]
    least: int
    window: int
    bits: float

    @property
    def most_sum(self) -> int:
        """The largest sum of c * log2(c) with which a window's entropy still reaches ``bits``."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * MICRO)


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdefABCDEF", ("[0-9]", "[A-Fa-f]"), 24, 20, 3.0),
    CharClass("entropy_text", _UPPER + _LOWER + _DIGITS + "+/_=-", ("[0-9]", "[A-Za-z]", "[g-zG-Z+/_=-]"), 24, 20, 3.7),
)

# Candidates that match one of these are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|redacted",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
MASK = "[SECRET]"


def _class_pattern(alphabet: str, least: int) -> str:
    return "[" + alphabet.replace("-", "") + ("-" if "-" in alphabet else "") + "]{%d,}" % least


def _spans(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Matches of ``pattern`` as structs (start, rank of kind, end, kind, hit), in order.

    Gaps (split) and matches (extract) alternate, so positions are running sums of their lengths.
    ``keep`` is an array of booleans beside the matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    flags = keep if keep is not None else F.transform(hits, lambda _: F.lit(True))
    rank = KINDS.index(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["flag"], F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")
    zipped = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), flags, lambda p, f: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), f.alias("flag")))
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    # most texts have no match: one search tells, and the rest isn't evaluated
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Assignments, access key ids and hexadecimal runs, as an array of spans by start and kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.char_length(v) >= LEAST_VALUE)
    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", long_enough), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def _window_range(candidate: Column, c: CharClass) -> Column:
    """First start and last end of the windows of enough entropy, relative to the candidate; null if there are none.

    The sum over characters of count * log2(count) changes only in the entries of the characters
    that enter and leave the window.
    """
    terms = [round(n * math.log2(n) * MICRO) if n else 0 for n in range(c.window + 2)]
    gain = F.array(*(F.lit(terms[n + 1] - terms[n]) for n in range(c.window + 1)))
    codes = F.transform(F.slice(F.split(candidate, ""), 1, F.char_length(candidate)), lambda x: F.instr(F.lit(c.alphabet), x))
    blank = F.array_repeat(F.lit(0), len(c.alphabet))

    def step(acc: Column, x: Column) -> Column:
        entering, leaving, at = x["entering"], x["leaving"], acc["at"] + 1
        less = F.element_at(acc["counts"], F.greatest(leaving, F.lit(1)))
        low = F.when(leaving == 0, F.lit(0)).otherwise(F.element_at(gain, F.greatest(less, F.lit(1))))
        more = F.element_at(acc["counts"], entering) - F.when(entering == leaving, 1).otherwise(0)
        total = acc["total"] - low + F.element_at(gain, more + 1)
        counts = F.transform(acc["counts"], lambda n, i: n + F.when(i + 1 == entering, 1).otherwise(0) - F.when(i + 1 == leaving, 1).otherwise(0))
        hit = (at >= c.window) & (total <= c.most_sum)
        return F.struct(
            at.alias("at"), counts.alias("counts"), total.alias("total"),
            F.when(hit & acc["first"].isNull(), at - c.window).otherwise(acc["first"]).alias("first"), F.when(hit, at).otherwise(acc["last"]).alias("last"),
        )

    behind = F.concat(F.array_repeat(F.lit(0), c.window), codes)
    pairs = F.zip_with(codes, F.slice(behind, 1, F.size(codes)), lambda e, l: F.struct(e.alias("entering"), l.alias("leaving")))
    nothing = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("at"), blank.alias("counts"), F.lit(0).alias("total"), nothing.alias("first"), nothing.alias("last"))
    return F.aggregate(pairs, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, c: CharClass) -> Column:
    """Spans of one character class, allow-list applied."""

    def wanted(s: Column) -> Column:
        ok = F.lit(True)
        for p in c.needs:
            ok = ok & F.rlike(s["hit"], F.lit(p))
        for p in ALLOWED:
            ok = ok & ~F.rlike(s["hit"], F.lit(p))
        return ok

    candidates = F.filter(_spans(text, _class_pattern(c.alphabet, c.least), c.kind), wanted)
    ranged = F.transform(candidates, lambda s: F.struct(s.alias("s"), _window_range(s["hit"], c).alias("w")))
    hot = F.filter(ranged, lambda r: r["w"]["first"].isNotNull())
    return F.transform(
        hot, lambda r: F.struct((r["s"]["start"] + r["w"]["first"]).alias("start"), r["s"]["rank"].alias("rank"), (r["s"]["start"] + r["w"]["last"]).alias("end"), r["s"]["kind"].alias("kind"), r["s"]["hit"].alias("hit"))
    )


def scan(docs: DataFrame, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "secret_spans") -> DataFrame:
    """Adds two arrays of spans to the rows of ``docs``: the base ones, and all of them.  Columns of those names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")
    found = docs.withColumn(base_col, F.when(text == "", none).otherwise(base_spans(text)))
    return found.withColumn(spans_col, F.array_sort(F.concat(F.col(base_col), *(F.when(text == "", none).otherwise(entropy_spans(text, c)) for c in CLASSES))))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The rows of ``docs`` with each secret in the text replaced by ``mask`` (overlapping spans by one); a null text stays null."""
    base, spans = free_name(docs, "__base"), free_name(docs, "__spans")
    found = scan(docs, text_col, base, spans)
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) == 0, text).otherwise(clean)).select(*docs.columns)


def secret_query(docs: DataFrame) -> DataFrame:
    """The digest of ``documents``."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))


def _duck_spans(pattern: str, kind: str, keep: str) -> str:
    rank = KINDS.index(kind)
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
        'start': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda h: length(h))), 0),
        'rank': {rank}, 'kind': '{kind}', 'hit': regexp_extract_all(t, '{pattern}')[i], 'value': {"regexp_extract_all(t, '" + pattern + "', 2)[i]" if kind == "assign" else "''"} }}), lambda s: {keep})"""


def oracle() -> str:
    """DuckDB SQL that recounts every window from scratch and sums positions anew for each match."""
    q = lambda p: p.replace("'", "''")
    made = [_duck_spans(q(ASSIGN), "assign", f"length(s.value) >= {LEAST_VALUE}"), _duck_spans(q(ACCESS), "access", "true"), _duck_spans(q(HEX), "hex", "true")]
    classes = []
    for c in CLASSES:
        keep = " AND ".join([f"regexp_matches(s.hit, '{q(p)}')" for p in c.needs] + [f"NOT regexp_matches(s.hit, '{q(p)}')" for p in ALLOWED])
        terms = "[" + ", ".join(str(round(n * math.log2(n) * MICRO)) for n in range(1, c.window + 1)) + "]"
        hot = f"""list_filter(range(0, length(hit) - {c.window} + 1), lambda i: list_sum(list_transform(map_values(list_aggregate(string_split(substring(hit, i + 1, {c.window}), ''), 'histogram')), lambda n: {terms}[n::BIGINT])) <= {c.most_sum})"""
        classes.append(f"""SELECT doc_id, start + first AS start, rank, start + last + {c.window} AS "end", kind FROM (
          SELECT *, list_min(w) AS first, list_max(w) AS last FROM (
            SELECT *, {hot} AS w FROM (SELECT doc_id, unnest(spans, recursive := true) FROM (SELECT doc_id, {_duck_spans(q(_class_pattern(c.alphabet, c.least)), c.kind, keep)} AS spans FROM d) WHERE len(spans) > 0)
          ) WHERE len(w) > 0)""")
    joined = lambda where: f"""coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") {where}, '')"""
    return f"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      b AS (SELECT doc_id, start, rank, start + length(hit) AS "end", kind FROM (SELECT doc_id, unnest(spans, recursive := true) FROM (SELECT doc_id, {" || ".join(made)} AS spans FROM d) WHERE len(spans) > 0)),
      s AS (SELECT * FROM b UNION ALL {" UNION ALL ".join(classes)})
      SELECT d.doc_id, count(kind) FILTER (kind = 'assign') AS n_assign, count(kind) FILTER (kind = 'access') AS n_access, count(kind) FILTER (kind = 'hex') AS n_hex,
        sha256({joined("FILTER (rank < 3)")}) AS base_sha256, {joined("FILTER (kind IS NOT NULL)")} AS spans
      FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
