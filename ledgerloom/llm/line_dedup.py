"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its different words (lower case, cut at white space); lines without words are
never removed.  A line goes when an earlier line of the corpus (smaller id, then smaller line number)
has a Jaccard similarity of at least ``SIMILAR`` hundredths, be that line itself kept or not.

Words are ordered by rarity: a fixed-size table of counters over all words of the corpus gives each
word its frequency class, and the word's hash breaks ties.  Similar sets share a word within their
prefixes, so prefixes are joined; pairs must also pass the length filter, the positional filter and
a bound from parity signatures before their full sets are compared.

Equal sets are one node.  Words in many prefixes are handled apart: lines are first tried against
single partners of such a word, and only the lines that no partner removes meet all earlier lines
of the word.  So a large group of near copies isn't expanded into its pairs, and no match is lost.

Null and empty texts have no lines.  Rows are told apart by id and text (64 bits of hash), and those
that share an id are ordered by that hash.  Rows that share both count as one document: what goes in
one goes in all, and their lines don't remove each other at equal line numbers.  Words are compared by
56 bits of hash and their frequency class, sets by 64 bits.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from .batches import free_name
from .components import checked, cut, discard

#: Least similarity in hundredths.
SIMILAR = 80
#: Counters of the frequency table (2 ** BITS bytes): its size doesn't depend on the corpus.
BITS = 20
#: Lines of more words have signatures of 128 parities, others of 64.
LONG = 96
#: Words in more prefixes than this are handled apart.
CROWD = 256
#: Partners that lines of such words are tried against.
TRIES = 4


def rarity_table(hashed: DataFrame, name: str | None = None) -> Column:
    """An array of one byte per counter: the frequency class of the words that fall on it.

    It is a variable of the session, for the caller to drop: the driver holds its bytes alone, no list of Python and no text in a plan.
    """
    spark = hashed.sparkSession
    word = hashed.select(F.explode("words").alias("w")).select(_slot(F.col("w")).alias("slot"), F.lit(1).alias("seen"))
    every = spark.range(1 << BITS).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("seen"))
    # classes are quarter powers of two within 7 bits
    rarity = F.least(F.floor(4 * F.log2(F.sum("seen") + 1)), F.lit(127)).cast("tinyint")
    counters = word.union(every).groupBy("slot").agg(rarity.alias("c"))
    parts = counters.groupBy(F.shiftright("slot", 10).alias("part")).agg(F.sort_array(F.collect_list(F.struct("slot", "c")))["c"].alias("c"))
    table = parts.agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "c")))["c"]))
    name = name or f"rarity_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} ARRAY<TINYINT>")
    spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {{table}})", table=table)
    return F.col(name)


def _frequency(count: int) -> int:
    """Frequency class of a count."""
    return math.floor(4 * math.log2(count + 1))


def _word(w: Column | str) -> Column:
    """What stands for a word: 56 bits of hash."""
    return F.shiftrightunsigned(F.xxhash64(w), 8)


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 56 - BITS).cast("int")


def rarest_first(words: Column, rarity: Column) -> Column:
    """A plain set ordered by rarity: frequency class above, hash below."""

    def code(h: Column) -> Column:
        # lambdas are interpreted, so each step counts; without a null the array is sorted as plain longs
        frequency = F.coalesce(F.get(rarity, _slot(h)), F.lit(0).cast("tinyint")).cast("long")
        return F.shiftleft(frequency, 56).bitwiseOR(h)

    return F.sort_array(F.transform(words, code))


def _spaced(text: Column | str) -> Column:
    """A text in lower case whose white space is spaces and line ends alone: a split at one plain character takes no regular expression."""
    return functools.reduce(lambda c, white: F.replace(c, F.lit(white), F.lit(" ")), "\t\x0b\f\r", F.lower(text))


def plain_set(line: Column) -> Column:
    """The different words of a line of ``_spaced`` by their hashes alone, as ``rarest_first`` holds them below the frequency class."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), _word)), _word(F.lit("")))


def _signature(words: str, size: Column) -> Column:
    """Parities of the words that share the low bits of their hash: 64 in ``low``, or for long lines 128 in ``low`` and ``high``.

    A word flips one parity, so two sets differ in at least as many words as parities.  The xor of both
    halves is the signature of 64.
    """
    flip = "shiftleft(1L, cast(x & 63 as int))"
    fold = F.expr(f"aggregate({words}, 0L, (a, x) -> a ^ {flip})")
    high = F.when(size > LONG, F.expr(f"aggregate({words}, 0L, (a, x) -> if(x & 64 = 0, a, a ^ {flip}))")).otherwise(F.lit(0).cast("long"))
    return F.struct(fold.bitwiseXOR(high).alias("low"), high.alias("high"))


def _once(value: Column) -> Column:
    """A value that is worked out once per row, however often later expressions name it."""
    return F.explode(F.array(value))


def _own(id_col: str, text_col: str) -> Column:
    """What tells rows apart and orders them: id, then hash of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (of ``_own``), line number and plain set of each line with words: texts are split once for the counts and the prefixes."""
    lines = docs.select(_own(id_col, text_col).alias("id"), F.posexplode(F.split(_spaced(text_col), "\n")).alias("line", "words"))
    return lines.select("id", "line", _once(plain_set(F.col("words"))).alias("words")).filter(F.size("words") > 0)


def _lines(hashed: DataFrame, rarity: Column) -> DataFrame:
    """id (of ``_own``), line number, set number, size, signature and prefix of each line with words."""
    n = F.size("words")
    prefix = n - F.ceil(n * SIMILAR / 100).cast("int") + 1
    made = hashed.select("id", "line", _once(rarest_first(F.col("words"), rarity)).alias("words"))
    return made.select("id", "line", F.xxhash64("words").alias("sid"), n.alias("n"), _signature("words", n).alias("sig"), F.slice("words", F.lit(1), prefix).alias("prefix"))


def _largest_partner(n: Column, at: Column) -> Column:
    """Most words of a set that can match one of ``n`` words if they share its word number ``at`` and none before."""
    # 100 * both >= SIMILAR * (n + m - both), and both <= n - at
    return F.floor(((100 + SIMILAR) * (n - at).cast("long") - SIMILAR * n.cast("long")) / SIMILAR + F.lit(1e-9)).cast("int")


def _possible(x: str, y: str) -> Column:
    """Whether the filters let a pair of prefix rows pass; the cheap ones, of length and position, stand first."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    low, high = (F.col(f"{x}.{part}").bitwiseXOR(F.col(f"{y}.{part}")) for part in ("low", "high"))
    differ = F.when(F.least(n, m) > LONG, F.bit_count(low) + F.bit_count(high)).otherwise(F.bit_count(low.bitwiseXOR(high)))
    return (m <= F.col(f"{x}.most")) & (n <= F.col(f"{y}.most")) & ((100 + SIMILAR) * (n + m - differ).cast("long") >= 2 * SIMILAR * (n + m).cast("long"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later set (sid) of each pair (x, y) whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.struct("id", "line").alias(f"{c}_at"), F.col("words").alias(f"{c}_words"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    shared = F.size(F.array_intersect("x_words", "y_words"))
    ok = both.filter(100 * shared >= SIMILAR * (F.size("x_words") + F.size("y_words") - shared))
    return ok.select(F.when(F.col("x_at") < F.col("y_at"), F.col("y")).otherwise(F.col("x")).alias("sid")).distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sid, first line (id, line) and plain word set of the wanted sets (sid, id, line, n, sig), read again from there.

    Size and signature have to agree, which tells texts apart that share an id and a hash.
    """
    lists = checked(cut(wanted.groupBy("id").agg(F.collect_list(F.struct("line", "sid", "n", "sig")).alias("wanted"))), F.size("wanted"))
    source = docs.select(_own(id_col, text_col).alias("own_id"), F.col(text_col).alias("own_text"))
    lines = F.split(_spaced("own_text"), "\n")
    found = source.join(lists, F.col("own_id").eqNullSafe(F.col("id"))).withColumn("lines", lines)
    picked = F.transform("wanted", lambda w: F.struct(w["sid"].alias("sid"), w["line"].alias("line"), w["n"].alias("n"), w["sig"].alias("sig"), F.get("lines", w["line"]).alias("text")))
    each = found.select("id", F.explode(picked).alias("w"))
    made = each.select(F.col("w.sid").alias("sid"), "id", F.col("w.line").alias("line"), "w.n", "w.sig", _once(plain_set(F.col("w.text"))).alias("words"))
    return made.filter((F.size("words") == F.col("n")) & (_signature("words", F.size("words")) == F.col("sig"))).select("sid", "id", "line", "words")


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines with words (id, line, sid), and those of them (id, line) that an earlier line matches; ids are those of ``_own``."""
    hashed = cut(_hashed(docs, id_col, text_col))
    rarity = f"rarity_{uuid.uuid4().hex}"
    try:
        made = cut(_lines(hashed, rarity_table(hashed, rarity)))
    finally:
        docs.sparkSession.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {rarity}")
    discard(hashed)
    sets = cut(made.groupBy("sid").agg(F.min(F.struct("id", "line")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix")).select("sid", "first.id", "first.line", "n", "sig", "prefix"))
    lines = cut(made.select("id", "line", "sid"))
    discard(made)
    # a word that stands once in the corpus matches nothing; one that stands CROWD times at most isn't crowded
    frequency = F.shiftrightunsigned("word", 56)
    placed = sets.select("sid", "n", "sig.low", "sig.high", F.posexplode("prefix").alias("at", "word")).filter(frequency > _frequency(1))
    posts = placed.select("sid", "n", "low", "high", _largest_partner(F.col("n"), F.col("at")).alias("most"), "word")
    crowded = cut(posts.filter(frequency >= _frequency(CROWD)).groupBy("word").count().filter(F.col("count") > CROWD).select("word"))
    light = posts.join(crowded, "word", "left_anti")
    pair = (F.col("x.sid").alias("x"), F.col("y.sid").alias("y"))
    pairs = cut(light.alias("x").join(light.alias("y"), "word").filter(_possible("x", "y") & (F.col("x.sid") < F.col("y.sid"))).select(*pair).distinct())
    heavy = cut(posts.join(crowded, "word", "left_semi").join(sets.select("sid", "id", "line"), "sid"))
    row, place = F.struct("id", "line", "sid", "n", "low", "high", "most"), F.struct("id", "line")
    earlier = F.struct("x.id", "x.line") < F.struct("y.id", "y.line")
    for k in range(TRIES):  # the earliest line of the word, then lines that a hash picks
        partner = heavy.groupBy("word").agg(F.min_by(row, place if k == 0 else F.xxhash64("sid", "word", F.lit(k))).alias("x")).select("word", "x.*")
        pairs = pairs.union(heavy.alias("y").join(partner.alias("x"), "word").filter(_possible("x", "y") & earlier).select(*pair))
    pairs = cut(pairs.distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        touched = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
        wanted = sets.join(touched, "sid", "left_semi").select("sid", "id", "line", "n", "sig")
        return _verified(pairs, cut(_full_sets(docs, wanted, id_col, text_col)))

    gone = cut(verified(pairs))
    open_ = heavy.join(gone, "sid", "left_anti")
    rest = cut(heavy.alias("x").join(open_.alias("y"), "word").filter(_possible("x", "y") & earlier).select(*pair).distinct().join(pairs, ["x", "y"], "left_anti"))
    if not rest.isEmpty():
        gone = cut(gone.union(verified(rest)).distinct())
    first = sets.select("sid", F.col("id").alias("first_id"), F.col("line").alias("first_line")).join(gone.withColumn("gone", F.lit(True)), "sid", "left")
    later = ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line")))
    return lines, lines.join(first, "sid").filter(F.col("gone").isNotNull() | later).select("id", "line").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with later matches taken out of the text; ``removed_lines`` (array of line numbers) is added.

    A null text stays null.  A column named removed_lines is replaced.
    """
    _, gone = later_matches(docs, id_col, text_col)
    own, taken, split_lines, text = (free_name(docs, c) for c in ("__id", "__gone", "__lines", "__kept"))
    lists = checked(cut(gone.groupBy(F.col("id").alias(own)).agg(F.sort_array(F.collect_list("line")).alias(taken))), F.size(taken))
    out = docs.join(lists, _own(id_col, text_col).eqNullSafe(F.col(own)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split_lines) - 1), F.col(taken))
    split = F.transform(stay, lambda i: F.get(split_lines, i))
    kept = out.withColumn(split_lines, _once(F.when(F.col(taken).isNotNull(), F.split(F.col(text_col), "\n")))).withColumn(text, _once(F.when(F.col(split_lines).isNull(), F.col(text_col)).otherwise(F.array_join(split, "\n"))))
    removed = F.coalesce(taken, F.array().cast("array<int>")).alias("removed_lines")
    return kept.select(*(F.col(text).alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "removed_lines"), removed)


def line_query(docs: DataFrame) -> DataFrame:
    """The digest of ``documents``: lines, lines removed and the hash of the text that stays."""
    kept = dedup_lines(docs.select("doc_id", "text", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines")))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", F.greatest(F.coalesce("n_lines", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text, 256).alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL with exact word frequencies, a prefix join and list intersections."""
    share = SIMILAR / 100
    return rf"""
      WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS INT) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
      w AS (SELECT doc_id, line, raw, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(raw), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS words FROM l),
      s AS (SELECT words, min(struct_pack(doc_id := doc_id, line := line)) AS first, len(words) AS n FROM w WHERE len(words) > 0 GROUP BY words),
      e AS (SELECT row_number() OVER (ORDER BY first) AS sid, words, first, n FROM s),
      t AS (SELECT sid, n, unnest(words) AS word FROM e),
      f AS (SELECT word, count(*) AS c FROM t GROUP BY word),
      p AS (SELECT sid, n, t.word, row_number() OVER (PARTITION BY sid ORDER BY c, t.word) AS nth FROM t JOIN f ON t.word = f.word),
      q AS (SELECT sid, n, word FROM p WHERE nth <= n - ceil(n * {share} - 1e-9) + 1),
      c AS (SELECT DISTINCT x.sid AS a, y.sid AS b FROM q AS x JOIN q AS y ON x.word = y.word AND x.sid < y.sid AND 100 * least(x.n, y.n) >= {SIMILAR} * greatest(x.n, y.n)),
      g AS (SELECT DISTINCT c.b AS sid FROM c JOIN e AS x ON x.sid = c.a JOIN e AS y ON y.sid = c.b WHERE 100 * len(list_intersect(x.words, y.words)) >= {SIMILAR} * (x.n + y.n - len(list_intersect(x.words, y.words)))),
      r AS (SELECT w.doc_id, w.line, w.raw, e.sid IS NOT NULL AND (g.sid IS NOT NULL OR e.first.doc_id <> w.doc_id OR e.first.line <> w.line) AS gone FROM w LEFT JOIN e ON e.words = w.words LEFT JOIN g ON g.sid = e.sid)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, CAST(strlen(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS BIGINT) AS kept_bytes, sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
      FROM r GROUP BY doc_id"""
