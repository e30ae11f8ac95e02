"""Source divergence audit: how the words of each source of a language differ from the other sources and from the language.

Every task counts the terms of bounded chunks of text with one DuckDB query, so that a (language, source, term) is one
row a chunk. The rows go to shards by a hash of language and term. A shard comes sorted by that hash and passes DuckDB
in batches of whole terms: one query adds the chunks up and keeps the terms of enough documents. Spark sums the kept
counts to totals of each source and language, which turn counts into shares. The kept counts, now small, go to shards
by language and term once more: one query makes the partial sums of pairs of sources that have a term both, one ranks
the terms in which a source exceeds its language. Spark adds the partial sums up and merges the rankings.

Pairs where a source lacks a term need no row a term. With p0 the share of a term that a source does not have,
a pair's sum over all kept terms is

    V f(p0a, p0b) + sum over terms of a of (f(pa, p0b) - f(p0a, p0b)) + the same for b
    + sum over common terms of (f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b))

and the middle sums only depend on how many terms of a source have a count, which is a short table.

All arithmetic is of integers. DuckDB runs inside the tasks with one thread and bounded memory, and has no files.

Defined results: null text, language and source are ''; documents without terms still make their group, whose shares
are those of counts of 0; a language without kept terms has pairs of value 0 and no terms; repeated rows are documents
of their own; ties go to the lower item by its bytes; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import bounded, durable, gathered, table

LEAST_DOCS = 10
TOP_TERMS = 10
ONE = 1_000_000_000
#: Characters that are in no term; all others make terms, A to Z as a to z.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
CHUNK = 20 << 20
#: Rows of counts that pass DuckDB together, and pairs of sources; a batch has one whole term at least.
BATCH_ROWS = 200_000
BATCH_PAIRS = 4_000_000

COUNTS = rf"""
WITH d AS (SELECT row_number() OVER () AS row, * FROM chunk),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(CASE WHEN strlen(text) = length(text) THEN lower(text) ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '{TERM}')) AS term FROM d),
e AS (SELECT row, lang, source, term, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM e GROUP BY lang, source, term"""

KEPT = """
SELECT h, lang, term, source, CAST(sum(n) AS BIGINT) AS n FROM batch GROUP BY h, lang, term, source
QUALIFY sum(sum(docs)) OVER (PARTITION BY lang, term) >= {least}"""

PARTS = """
WITH s AS (SELECT *, 1 + CAST(CAST({one} AS HUGEINT) * (sum(n) OVER (PARTITION BY lang, term) + 2) // (all_n + 2 * v) AS BIGINT) AS q FROM batch),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}),
f AS (SELECT a.lang, a.source, b.source AS item,
  (a.p - b.p) * (a.p - b.p) // (a.p + b.p) - (a.p - b.p0) * (a.p - b.p0) // (a.p + b.p0) - (a.p0 - b.p) * (a.p0 - b.p) // (a.p0 + b.p) + (a.p0 - b.p0) * (a.p0 - b.p0) // (a.p0 + b.p0) AS value
  FROM batch a JOIN batch b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source)
SELECT * FROM t UNION ALL SELECT lang, source, 'pair', item, CAST(sum(value) AS BIGINT) FROM f GROUP BY lang, source, item"""


def _duck():  # noqa: ANN202
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for b in gathered(batches, "text", CHUNK):
            con.register("chunk", pa.Table.from_batches([b]))
            yield from con.sql(COUNTS).to_arrow_table().to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def whole_terms(batches: Iterator[pa.RecordBatch], rows: int, pairs: int) -> Iterator[pa.Table]:
    """Sorted batches cut anew, so that rows of one ``h`` are never apart; a batch has about ``rows`` rows, or ``pairs`` pairs of one ``h``."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows // 8:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        h = whole["h"].to_numpy()
        starts = np.r_[0, np.nonzero(np.diff(h))[0] + 1]
        sizes = np.diff(starts)  # of all terms but the last, which may go on
        at = 0
        group = np.minimum(np.cumsum(sizes.astype(np.float64) ** 2) // pairs, 1e9).astype(np.int64) if pairs else np.zeros(len(sizes), np.int64)
        for cut in [*(np.nonzero(np.diff(group))[0] + 1).tolist(), len(sizes)]:
            if starts[cut] > at:
                yield whole.slice(at, int(starts[cut]) - at)
                at = int(starts[cut])
        held = whole.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _sharded(cells: DataFrame, sql: str, schema: str, rows: int = BATCH_ROWS, pairs: int = 0) -> DataFrame:
    """``sql`` over ``batch``: whole terms of a shard by the hash ``h`` of language and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for t in whole_terms(batches, rows, pairs):
            con.register("batch", t)
            yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=50_000)

    return cells.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10 ** 9 * (n + 2) / (total + 2 * terms)), exactly."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of sources from each other, and the terms that set a source off."""
    bounded(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = _counts(docs).withColumn("h", F.xxhash64("lang", "term"))
    kept = durable(_sharded(counted, KEPT.format(least=least_docs), "h long, lang string, term string, source string, n long"), "kept")

    # totals: a row of each group and of each language
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("all_n")).join(kept.select("lang", "term", "h").groupBy("lang").agg(F.count_distinct("term").alias("v")), "lang")
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["own_n", "all_n", "v"])
    groups = durable(groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("own_n"), F.col("v")), F.lit(1))), "groups")

    cells = kept.join(groups, ["lang", "source"]).select("h", "lang", "term", "source", "n", share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"), "p0", "all_n", "v")
    parts = durable(_sharded(cells, PARTS.format(one=ONE, top=top), "lang string, source string, part string, item string, value long", pairs=BATCH_PAIRS), "parts")

    # pairs: what all terms, the terms of one side and the common terms add
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    every = groups.join(others, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * distance(F.col("p0"), F.col("q0"))).alias("value"))
    sizes = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    sizes = sizes.select("lang", "source", "terms", "p0", share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"))
    one = sizes.join(others, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))).alias("value"))
    half = one.unionByName(parts.where("part = 'pair'").select("lang", "source", "item", "value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = half.select("lang", "value", sides.alias("s")).select("lang", "s.source", "s.item", "value")
    pairs = every.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank)
    terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM d GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM d GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS MATERIALIZED (SELECT lang, source, term, n,
  CAST(1 + CAST({ONE} AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p,
  CAST(1 + CAST({ONE} AS HUGEINT) * (all_n + 2) // (sum(all_n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS q FROM x),
v AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM s a JOIN s b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM t)
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= {TOP_TERMS}"""
