"""Target-distribution importance resampling in Spark SQL.

The words of a text and their pairs are its features; crc32 deals the features into buckets.  Counts by
bucket over all texts of the corpus and of the target give each bucket a gain, the logarithm of how much
more often the target has it.  A text's weight is the mean gain of its features.  A score adds noise that
follows from the id alone (the Gumbel distribution), so that the highest scores are a draw without
replacement, with chances that follow the weights.

Features are exploded twice, once to count and once to add up; both times rows combine within tasks
before anything is shuffled: at most one row a bucket and task, and one row a text.  Gains are one row a
bucket, and broadcast.  Ranks come from one distributed sort, written to the shared folder: a row's place
in its partition plus the rows of the partitions before.

Null texts hold no words: no features, weight 0.  Rows with equal ids count and are drawn each on their
own, ordered by a hash of the text; a null id counts as the empty string in the noise and comes last among
ties.  A target without features gives each bucket the gain of a count of 0.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from . import components as C

#: What isn't a letter of ASCII, a digit or beyond ASCII ends a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25


def words(text: Column) -> Column:
    """Words of a text in lower case (A to Z only); of a null text none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(WORD), F.lit(0))


def features(words_col: str) -> Column:
    """Generator of ``feature``: each word, and each pair of neighbours joined by a blank."""
    w = F.col(words_col)
    but_one = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), but_one), F.slice(w, F.lit(2), but_one), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.explode(F.concat(w, pairs)).alias("feature")


def bucket(buckets: int) -> Column:
    """Bucket of a ``feature``."""
    return (F.crc32(F.encode(F.col("feature"), "UTF-8")) % buckets).cast("int").alias("bucket")


def counts(texts: DataFrame, text_col: str, buckets: int, out: str) -> DataFrame:
    """``bucket`` and the number of features in it."""
    exploded = texts.select(words(F.col(text_col)).alias("words")).select(features("words"))
    return exploded.groupBy(bucket(buckets)).agg(F.count("*").alias(out))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``bucket`` and ``gain`` in thousandths for every bucket: one row each, written to the shared folder."""
    spark = docs.sparkSession
    found = counts(docs, text_col, buckets, "s").join(counts(target, target_col, buckets, "t"), "bucket", "full")
    every = spark.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left").fillna(0, ["s", "t"])
    totals = C.cut(every)
    total = totals.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * F.lit(float(total.S + buckets))) / ((d("s") + 1) * F.lit(float(total.T + buckets)))
    return totals.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(id_col: str, seed: int) -> Column:
    """Thousandths of a Gumbel variate that follows from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: ``row``, ``id``, ``tie``, ``n_words``, ``n_features`` and ``weight``."""
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), words(F.col(text_col)).alias("words"))
    own = F.when(F.size("words") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("words"))  # a text without words keeps one row
    keys = ("row", "id", "tie", "n_words")
    exploded = held.withColumns({"n_words": F.size("words"), "words": own}).select(*keys, features("words")).select(*keys, bucket(buckets))
    summed = exploded.join(F.broadcast(gain), "bucket", "left").groupBy(*keys).agg(F.count("bucket").alias("n_features"), F.sum("gain").alias("total"))
    n = F.col("n_features")
    mean = F.expr("(total - pmod(total, n_features)) div n_features")  # goes down
    return summed.withColumn("weight", F.when(n > 0, mean).otherwise(0).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every text; rank is null for a text that isn't drawn.

    Of the texts with at least ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    weighed = weights(docs, gains(docs, target, buckets, text_col, target_col), buckets, id_col, text_col)
    scored = weighed.select("row", "id", "tie", "n_features", "weight", (F.col("weight") + noise("id", seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    # every key is different (the row settles ties), so that range partitions split anywhere
    ordered = scored.orderBy(F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), "tie", "row")
    placed = C.cut(ordered.drop("row", "tie").withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if("able").alias("able"))  # a row a partition
    offsets, before, able = [], 0, 0
    for r in sizes.orderBy("part").collect():
        offsets.append((r.part, before))
        before, able = before + r.rows, able + r.able
    offset = docs.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("within") + 1
    drawn = percent * able // 100
    ranked = placed.withColumn("part", part).withColumn("within", within).join(F.broadcast(offset), "part")
    return ranked.select(F.col("id").alias(id_col), F.col("n_features").cast(LongType()), "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def oracle(percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The same in DuckDB; crc32 byte by byte for each different feature."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = WORD.replace("\\x00", "\\x{00}")
    both = lambda t, i: f"SELECT {i} AS id, regexp_extract_all({lower}, '{pattern}') AS w FROM {t}"
    # one step of the polynomial for each of eight bits, for each value of a byte
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    bits = "SELECT i, CAST(i AS BIGINT) AS c, 0 AS n FROM range(256) t(i) UNION ALL SELECT i, " + bit + ", n + 1 FROM steps WHERE n < 8"
    return f"""WITH RECURSIVE steps AS ({bits}), tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tb FROM steps WHERE n = 8),
        d AS MATERIALIZED ({both('documents', 'doc_id')}), b AS MATERIALIZED ({both('benchmark', 'item_id')}),
        f AS MATERIALIZED (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
        g AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
        h AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT))),
            lambda c, e: xor(c >> 8, tb[1 + (xor(c, e) & 255)])), 4294967295) % {buckets} AS k FROM (SELECT DISTINCT f FROM (SELECT f FROM f UNION ALL SELECT f FROM g)), tab),
        s AS (SELECT k, count(*) AS s FROM f JOIN h USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM g JOIN h USING (f) GROUP BY k),
        n AS (SELECT (SELECT count(*) FROM f) AS fs, (SELECT count(*) FROM g) AS ft),
        gain AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (fs + {buckets})) / ((coalesce(s, 0) + 1)::DOUBLE * (ft + {buckets})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k), n),
        w AS (SELECT id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN h USING (f) JOIN gain USING (k) GROUP BY id),
        r AS (SELECT d.id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(d.w) >= {least_words} AS able,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{seed}:' || d.id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (id)),
        o AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS able_n FROM r)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * able_n // 100 THEN place END AS rank FROM o"""
