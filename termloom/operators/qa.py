"""Question and answer rows from articles, by two passes over a language model, with filters before each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import n_words, repaired, snippet, split_words, strip
from termloom.operators.chunk import capped_windows
from termloom.operators.models import Extractive, LanguageModel, Window, complete
from termloom.operators.replies import ReplyStore

#: Words that an article and a chunk must have, tokens of a chunk, their overlap, the most in a chunk, and in a prompt.
ARTICLE_WORDS, CHUNK_WORDS, CHUNK, CHUNK_OVERLAP, CHUNK_MOST, PROMPT_MOST = 100, 50, 500, 100, 7192, 8192


def gated_articles(articles: DataFrame) -> DataFrame:
    return articles.where(n_words(F.col("content")) >= ARTICLE_WORDS)


def _counted_chunks(articles: DataFrame) -> DataFrame:
    """gated_chunks() with n_tokens. Articles are cut into words once, for their gate and their windows."""
    words = articles.select("title", split_words(F.col("content")).alias("tokens")).where(F.size("tokens") >= ARTICLE_WORDS)
    found = capped_windows(words, "tokens", CHUNK, CHUNK_OVERLAP, CHUNK_MOST)
    return found.where(F.col("n_tokens") >= CHUNK_WORDS).select("title", F.col("chunk_id").alias("chunk_index"), F.col("text").alias("chunk"), "n_tokens")


def gated_chunks(articles: DataFrame) -> DataFrame:
    """title, chunk_index and chunk of articles (title, content) that pass both gates."""
    return _counted_chunks(articles).drop("n_tokens")


def within_budget(prompt: Column, most: int = PROMPT_MOST, system: str = "", count: Callable[[Column], Column] = n_words) -> Column:
    """Whether a system prompt and a prompt together have `most` tokens at most, as `count` counts them."""
    return count(F.concat(F.lit(system), prompt)) <= most


def questions(reply: Column) -> Column:
    """The questions of a reply, stripped, without blank ones; none if it isn't such an object."""
    own = F.coalesce(F.from_json(repaired(reply), "questions array<string>")["questions"], F.array().cast("array<string>"))
    return F.filter(F.transform(own, strip), lambda q: q != "")


def answer(reply: Column) -> Column:
    """question and answer of a reply, null unless it has both."""
    own = F.from_json(repaired(reply), "question string, answer string")
    return F.when(own["question"].isNotNull() & own["answer"].isNotNull(), own)


def qa_rows(articles: DataFrame, factory: Callable[[], LanguageModel] = Extractive, store: ReplyStore | None = None, window: Window | None = None) -> DataFrame:
    """source_article, chunk_index, question, answer, context. Replies that can't be read drop their row. With a store, prompts that
    it has replies to aren't asked, here or in a later run, and equal ones once.

    The first pass is stored before the second reads it, so that no prompt is asked twice, even if executors are lost. Needs a
    checkpoint folder."""
    asks, answers = "task: questions\n---\n", ("task: answer\nquestion: ", "\n---\n")
    first = _counted_chunks(articles).withColumn("prompt", F.concat(F.lit(asks), F.col("chunk")))
    ask = store.complete if store else complete
    fits = lambda head: n_words(head) + F.col("n_tokens") <= PROMPT_MOST  # noqa: E731  within_budget() of the prompt: a chunk's words are counted
    asked = ask(first.where(fits(F.lit(asks))), "prompt", "reply", factory, window=window)
    each = asked.select("title", "chunk_index", "chunk", "n_tokens", F.explode(questions(F.col("reply"))).alias("question")).checkpoint()
    head = F.concat(F.lit(answers[0]), F.col("question"), F.lit(answers[1]))
    second = each.withColumn("prompt", F.concat(head, F.col("chunk")))
    told = ask(second.where(fits(head)), "prompt", "reply", factory, window=window).withColumn("a", answer(F.col("reply")))
    return told.where("a IS NOT NULL").select(F.col("title").alias("source_article"), "chunk_index", "a.question", "a.answer", snippet(F.col("chunk")).alias("context"))


def summary(rows: DataFrame) -> DataFrame:
    """n_rows and n_articles of question and answer rows."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("source_article").alias("n_articles"))


def throughput(rows: DataFrame, seconds: float) -> DataFrame:
    """requests and tokens of rows (prompt, reply), and how many a second."""
    return rows.agg(F.count("*").alias("requests"), F.sum(n_words(F.col("prompt")) + n_words(F.col("reply"))).alias("tokens")).withColumns({"requests_per_s": F.col("requests") / seconds, "tokens_per_s": F.col("tokens") / seconds})
