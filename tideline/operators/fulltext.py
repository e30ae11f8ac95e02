"""Full-text search over an inverted index: web-search queries of words, "phrases", -exclusions and OR.

The index is a table of (term, doc_id, positions) in the shared folder. A query becomes alternatives, each of atoms that
have to be in a text and atoms that must not; an atom is a word or a phrase. All atoms of all queries are found in one
pass over the rows of their terms: a position less a word's place in its atom is where the atom would begin, and an atom
is there where all its words agree on that. Nothing but the queries themselves is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import load, query
from tideline.session import written

#: What is in no token.
APART = r"[^\p{L}\p{N}]+"
#: (atoms that must be there, atoms that must not) of each alternative; an atom is a tuple of words.
Alternatives = list[tuple[list[tuple[str, ...]], list[tuple[str, ...]]]]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), APART), lambda t: t != "")


def parse(text: str) -> Alternatives:
    """Words next to each other are all required, ``or`` between them starts an alternative, ``-`` excludes, quotes make a phrase."""
    out: Alternatives = [([], [])]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if not minus and word.lower() == "or":
            out.append(([], []))
            continue
        atom = tuple(t for t in re.split(r"[\W_]+", (phrase or word).lower()) if t)
        if atom:
            out[-1][1 if minus else 0].append(atom)
    return [a for a in out if a[0] or a[1]]


def index(docs: DataFrame) -> DataFrame:
    """(term, doc_id, positions), dealt and sorted by term so that a query's terms are found by file statistics."""
    spread = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    held = spread.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return written(held.repartitionByRange("term").sortWithinPartitions("term", "doc_id"), "index")


def search(docs: DataFrame, held: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query, doc_id, rank, first): rank is the share of a text's tokens that begin an atom asked for; first is where.

    Every text is a candidate, also for queries that only exclude; null texts have no tokens.
    """
    spark = docs.sparkSession
    parsed = {q: parse(text) for q, text in queries.items()}
    atoms = sorted({a for alts in parsed.values() for must, never in alts for a in must + never})
    number = {a: i for i, a in enumerate(atoms)}
    words = spark.createDataFrame([(w, i, k, len(a)) for a, i in number.items() for k, w in enumerate(a)], "term string, atom int, place int, size int")
    at = held.join(F.broadcast(words), "term").select("doc_id", "atom", "size", F.explode("positions").alias("pos"), "place")
    there = at.groupBy("doc_id", "atom", "size", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).where("n = size")
    per = there.groupBy("doc_id", "atom").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    hits = per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("atom", F.struct("n", "first").alias("v")))).alias("hits"))
    every = docs.select("doc_id", F.size(F.coalesce(tokens(F.col("text")), F.array())).alias("length")).join(hits, "doc_id", "left")
    has = lambda a: F.coalesce(F.map_contains_key("hits", F.lit(number[a])), F.lit(False))
    found = []
    for q, alts in parsed.items():
        holds = F.lit(False)
        for must, never in alts:
            one = F.lit(True)
            for a in must:
                one = one & has(a)
            for a in never:
                one = one & ~has(a)
            holds = holds | one
        asked = sorted({number[a] for must, _ in alts for a in must})
        of = F.filter(F.transform(F.array(*map(F.lit, asked)) if asked else F.array().cast("array<int>"), lambda a: F.col("hits")[a]), lambda v: v.isNotNull())
        total = F.aggregate(of, F.lit(0).cast("long"), lambda acc, v: acc + v["n"])
        first = F.array_min(F.transform(of, lambda v: v["first"]))
        found.append(every.where(holds).select(F.lit(q).alias("query"), "doc_id", F.round(F.coalesce(total, F.lit(0)) / (1 + F.col("length")), 9).alias("rank"), F.coalesce(first, F.lit(-1)).alias("first")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


QUERIES = {"words": "the OF", "phrase": '"in the" -that', "either": 'der und or "de la"', "without": "-the -der", "mixed": 'los "the re" or with -from or "and the"'}


def _oracle() -> str:
    """Atoms as patterns in a text whose tokens each stand between spaces of their own."""
    pattern = lambda a: " " + "  ".join(a) + " "
    parts = []
    for q, text in QUERIES.items():
        alts = parse(text)
        holds = " OR ".join("(" + " AND ".join([f"contains(t, '{pattern(a)}')" for a in must] + [f"NOT contains(t, '{pattern(a)}')" for a in never]) + ")" for must, never in alts)
        asked = sorted({a for must, _ in alts for a in must})
        n = " + ".join(f"(length(t) - length(replace(t, '{pattern(a)}', ''))) / {len(pattern(a))}" for a in asked) or "0"
        starts = ", ".join(f"CASE WHEN contains(t, '{pattern(a)}') THEN len(string_split(substring(t, 1, strpos(t, '{pattern(a)}')), '  ')) - 1 END" for a in asked)
        first = f"coalesce(least({starts}), -1)" if asked else "-1"
        parts.append(f"SELECT '{q}' AS query, doc_id, round(({n}) / (1 + size), 9) AS rank, CAST({first} AS INTEGER) AS first FROM d WHERE {holds}")
    return r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM documents),
d AS (SELECT doc_id, ' ' || replace(k, ' ', '  ') || ' ' AS t, CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END AS size FROM k) """ + " UNION ALL ".join(parts)


@query("search_fulltext", _oracle())
def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-134: several web-search queries over all texts of all languages by an inverted index with positions."""
    docs = load(spark, sf_dir, "documents")
    return search(docs, index(docs), QUERIES)
