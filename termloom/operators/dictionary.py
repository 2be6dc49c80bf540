"""A dictionary of terms: merging what chunks define, and looking terms up."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.similarity import gestalt_ratio, letters_bound


def merge_last(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """One value for each key: that of the last row by `order` (chunk, place), as an update in that order would leave it."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def merge_ordered(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """merge_last() with ord, the place by `order` where a key first came: a dictionary keeps that when a value is replaced."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias("ord"))


def replace_lists(rows: DataFrame, surface: str, compound: str, *order: str) -> DataFrame:
    """surface and compounds, the sorted list of the last group of rows by `order`: later lists replace earlier ones, whole."""
    lists = rows.groupBy(surface, *order).agg(F.sort_array(F.collect_set(compound)).alias("compounds"))
    return lists.groupBy(surface).agg(F.max_by("compounds", F.struct(*order)).alias("compounds"))


def upsert(old: DataFrame, new: DataFrame, key: str = "term") -> DataFrame:
    """old with the rows of new in place of those of the same key. new has a key once, as merge_last leaves it."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def lookup_exact(dictionary: DataFrame, query: str) -> DataFrame:
    """The entry whose key is the query in lower case. Keys are compared as they are stored, so those with capitals aren't found."""
    return dictionary.where(F.col("term") == query.lower())


def lookup_fuzzy(dictionary: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The n entries with the largest ratios to the query, ties by `ord`: rank, term, definition, similarity.

    The ratio is a vectorised Python function over all terms; only n rows a task reach the last step."""
    spread = dictionary.repartition(dictionary.sparkSession.sparkContext.defaultParallelism)
    scored = spread.withColumn("similarity", gestalt_ratio(F.lit(query.lower()), F.col("term")))
    top = scored.orderBy(F.desc("similarity"), "ord").limit(n)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "ord", "term", "definition", "similarity"))).alias("x"))
    return ranked.select(F.posexplode("x").alias("p", "r")).select((F.col("p") + 1).alias("rank"), "r.term", "r.definition", "r.similarity")


def dict_lookup(dictionary: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The exact entry, if it has a definition that isn't empty, else fuzzy ones: exact_match, rank, term, definition, similarity."""
    exact = lookup_exact(dictionary, query).where("definition <> ''").select(F.lit(True).alias("exact_match"), F.lit(1).alias("rank"), "term", "definition", F.lit(1.0).alias("similarity"))
    none = exact.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("one"))
    fuzzy = lookup_fuzzy(dictionary, query, n).join(F.broadcast(none)).select(F.lit(False).alias("exact_match"), "rank", "term", "definition", "similarity")
    return exact.unionByName(fuzzy)


def exact_each(dictionary: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of queries (query_id, query) whose entry has a definition that isn't empty, as dict_lookup gives them."""
    own = queries.withColumn("term", F.lower("query")).join(dictionary.where("definition <> ''"), "term")
    return own.select("query_id", F.lit(True).alias("exact_match"), F.lit(1).alias("rank"), "term", "definition", F.lit(1.0).alias("similarity"))


def _best(scored: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "ord"))
    return scored.withColumn("rank", place).where(F.col("rank") <= n)


def fuzzy_exhaustive(terms: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, ord, similarity and rank of the n terms (ord, term) nearest to each row of queries (query_id, query): the stated
    queries, packed in blocks, meet every term, and what their letters rule out isn't compared."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // 256))))
    packed = queries.select(F.struct("query_id", F.lower("query").alias("query")).alias("q"), block.alias("_b")).groupBy("_b").agg(F.collect_list("q").alias("qs"))
    met = terms.select("ord", "term").repartition(terms.sparkSession.sparkContext.defaultParallelism).crossJoin(packed.select("qs")).select("ord", "term", F.inline("qs"))
    bound = met.withColumn("_bound", letters_bound(F.col("query"), F.col("term")))
    few = bound.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_bound"), "ord"))).where(F.col("_n") <= n)
    least = few.groupBy("query_id").agg(F.min(gestalt_ratio(F.col("query"), F.col("term"))).alias("_least"))
    left = bound.join(least, "query_id").where(F.col("_bound") >= F.col("_least") - SLACK)
    return _best(left.select("query_id", "ord", gestalt_ratio(F.col("query"), F.col("term")).alias("similarity")), n)


#: What rounding may take from a ratio, letters of a gram, grams of a query that are looked up for a first guess (the rarest), and
#: guesses that are compared for each one that is wanted.
SLACK, GRAM, GRAMS, GUESSES = 1e-9, 3, 6, 3


def _grams(text: Column) -> Column:
    """The distinct runs of GRAM letters of a text with a blank at either end."""
    own = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(own) - GRAM + 1, F.lit(1))), lambda i: F.substring(own, i, F.lit(GRAM))))


def first_guesses(terms: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, query and least, a ratio that n terms reach at least, of those queries for which n terms are guessed: the terms
    with most of a query's rarest grams are compared, and the n-th of their ratios is what others have to reach."""
    index = terms.select("ord", "term", F.explode(_grams(F.col("term"))).alias("gram"))
    own = queries.select("query_id", F.lower("query").alias("query")).where("query <> ''")
    asked = own.select("query_id", F.explode(_grams(F.col("query"))).alias("gram"))
    seen = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rare = asked.join(seen, "gram").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "gram"))).where(F.col("_n") <= GRAMS)
    met = rare.join(index.select("gram", "ord", "term"), "gram").groupBy("query_id", "ord").agg(F.count("*").alias("shared"), F.first("term").alias("term"))
    near = Window.partitionBy("query_id").orderBy(F.desc("shared"), F.length("term"), "ord")
    guessed = met.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= GUESSES * n).join(own, "query_id")
    compared = guessed.select("query_id", "query", "ord", gestalt_ratio(F.col("query"), F.col("term")).alias("similarity"))
    return _best(compared, n).groupBy("query_id", "query").agg(F.min("similarity").alias("least"), F.count("*").alias("n")).where((F.col("n") >= n) & (F.col("least") > 0)).select("query_id", "query", "least")


def _letters(text: str, rank: dict[str, int]) -> list[str]:
    """A text's letters, each with how often it has come by then, the rarest first by rank: of two texts as many are the same as
    they have letters in common."""
    count: Counter = Counter()
    out = []
    for c in text:
        count[c] += 1
        out.append(f"{c}{count[c]}")
    return sorted(out, key=lambda x: (rank.get(x, -1), x))


def candidates(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct (query_id, ord): for each row of asked (query_id, query, least) the terms that can reach the ratio `least`, by their
    length and by an index of counted letters.

    To reach it, two texts of some lengths need so many letters in common; so one of the rarest of either, as many as it has beyond
    that number and one more, is a rare one of the other too. The index holds those of the terms by letter and length, and a
    query looks its own up for each length that can reach the ratio."""
    spark = terms.sparkSession
    lengths = sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())  # numbers alone

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = Counter(x for t in frame["term"] for x in _letters(t, {}))
            yield pd.DataFrame({"letter": list(n), "n": list(n.values())})

    often = terms.select("term").mapInPandas(counted, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(RANKED)
    shared = spark.sparkContext.broadcast({r.letter: len(lengths) + r.n for r in often.collect()})

    def posted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(x, len(t), place, o) for o, t in zip(frame["ord"], frame["term"], strict=True) for place, x in enumerate(_letters(t, shared.value))]
            yield pd.DataFrame(rows, columns=["letter", "length", "place", "ord"])

    def looked_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query_id, query, least in zip(frame["query_id"], frame["query"], frame["least"], strict=True):
                own = _letters(query, shared.value)
                for length in lengths:
                    common = max(1, math.ceil(least * (len(query) + length) / 2 - 1e-6))
                    if common <= min(len(query), length):
                        rows += [(query_id, x, length, length - common) for x in own[: len(query) - common + 1]]
            yield pd.DataFrame(rows, columns=["query_id", "letter", "length", "upto"])

    kind = terms.schema["ord"].dataType.simpleString()
    index = terms.select("ord", "term").mapInPandas(posted, f"letter string, length int, place int, ord {kind}")
    probes = asked.mapInPandas(looked_up, f"query_id {asked.schema['query_id'].dataType.simpleString()}, letter string, length int, upto int")
    return probes.join(index, ["letter", "length"]).where("place <= upto").select("query_id", "ord").distinct()


#: Counted letters whose rarity is told apart; rarer ones count as equally rare.
RANKED = 50_000


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, where the session has one; else as it is."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def fuzzy_ranked(terms: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, ord, similarity and rank of the n terms (ord, term) with the largest ratios to each row of queries (query_id,
    query), ties to smaller ord: exact. Queries for which grams give no first guess meet every term. With a checkpoint folder, the
    first guesses are made once."""
    asked = cut(first_guesses(terms, queries, n))
    met = candidates(terms, asked).join(terms.select("ord", "term"), "ord").join(asked, "query_id")
    left = met.where(letters_bound(F.col("query"), F.col("term")) >= F.col("least") - SLACK)
    scored = left.select("query_id", "ord", gestalt_ratio(F.col("query"), F.col("term")).alias("similarity"))
    names = ["query_id", "ord", "similarity", "rank"]
    rest = queries.join(asked.select("query_id"), "query_id", "left_anti")
    return _best(scored, n).select(*names).unionByName(fuzzy_exhaustive(terms, rest, n).select(*names))


def fuzzy_each(dictionary: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """lookup_fuzzy for every row of queries (query_id, query), with query_id. ord is a term's own; null terms and queries are in
    no row."""
    terms = dictionary.where("term IS NOT NULL")
    found = fuzzy_ranked(terms.select("ord", "term"), queries.where("query IS NOT NULL").select("query_id", "query"), n)
    return found.join(terms.select("ord", "term", "definition"), "ord").select("query_id", F.lit(False).alias("exact_match"), "rank", "term", "definition", "similarity")


def dict_lookup_each(dictionary: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """dict_lookup for every row of queries (query_id, query), with query_id."""
    exact = exact_each(dictionary, queries)
    return exact.unionByName(fuzzy_each(dictionary, queries.join(exact.select("query_id"), "query_id", "left_anti"), n))
