"""Models behind small interfaces: tokenizers, embedders and language models, with deterministic stand-ins that need no network.

A model is created once by each task that uses it, on the executor; what is passed around is a factory.
"""

from __future__ import annotations

import hashlib
import json
import queue
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

TOKENS = "array<struct<surface string, pos string>>"


class Tokenizer(Protocol):
    def tokenize(self, text: str) -> list[tuple[str, str]]: ...


class LanguageModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class WordTokenizer:
    """Words between white space, all of them nouns."""

    def tokenize(self, text: str) -> list[tuple[str, str]]:
        return [(w, "名詞") for w in text.split()]


def lattice_tokens(lines: str) -> list[tuple[str, str]]:
    """Tokens of a morphological analyser's text form: surface, tab, fields by comma; the last line ends it."""
    rows = [x.split("\t", 1) for x in lines.split("\n")[:-1] if "\t" in x]
    return [(surface, fields.split(",")[0] or "UNKNOWN") for surface, fields in rows]


def _sudachi() -> Tokenizer:
    from sudachipy import dictionary, tokenizer

    class Sudachi:
        own = dictionary.Dictionary(dict="full").create()

        def tokenize(self, text: str) -> list[tuple[str, str]]:
            found = self.own.tokenize(text, tokenizer.Tokenizer.SplitMode.C)
            return [(m.surface(), (m.part_of_speech() or ["UNKNOWN"])[0]) for m in found]

    return Sudachi()


def _mecab() -> Tokenizer:
    import MeCab

    class MeCabTokenizer:
        own = MeCab.Tagger()

        def tokenize(self, text: str) -> list[tuple[str, str]]:
            return lattice_tokens(self.own.parse(text).rstrip("\n"))

    return MeCabTokenizer()


#: Factories by name. The analysers' libraries are needed on the executors alone.
TOKENIZERS: dict[str, Callable[[], Tokenizer]] = {"words": WordTokenizer, "sudachi": _sudachi, "mecab": _mecab}


def get_tokenizer(name: str) -> Callable[[], Tokenizer]:
    if name.lower() not in TOKENIZERS:
        raise ValueError(f"no tokenizer is named {name!r}; there are {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name.lower()]


def tokens(text: Column, factory: Callable[[], Tokenizer]) -> Column:
    @pandas_udf(TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = factory()
        for texts in batches:
            yield texts.map(lambda t: [{"surface": s, "pos": p} for s, p in own.tokenize(t)] if t is not None else None)

    return run(text)


class HashedNgrams:
    """Unit vectors of hashed character trigrams."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, t in zip(out, texts, strict=True):
            for i in range(max(1, len(t) - 2)):
                h = hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % self.dimensions] += 1 if h[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embeddings(text: Column, factory: Callable[[], Embedder] = HashedNgrams) -> Column:
    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = factory()
        for texts in batches:
            yield pd.Series(list(own.embed(texts.fillna("").tolist())))

    return run(text)


class Extractive:
    """A stand-in for a language model: it answers each kind of prompt from the prompt's own text."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        fields = dict(re.findall(r"^(\w+): (.*)$", prompt.split("\n---\n")[0], re.M))
        body = prompt.split("\n---\n", 1)[-1]
        if fields.get("task") == "filter":
            return json.dumps({"terms": sorted(set(json.loads(fields["candidates"])))}, ensure_ascii=False)
        if fields.get("task") == "define":
            term = fields["term"]
            said = [s.strip() for s in re.split(r"[.。\n]", body) if term in s]
            return json.dumps({"term": term, "definition": said[0] if said else ""}, ensure_ascii=False)
        if fields.get("task") == "questions":
            first = body.split()
            return json.dumps({"questions": [f"What is said about {first[0]}?"] if first else []}, ensure_ascii=False)
        if fields.get("task") == "answer":
            return "```json\n" + json.dumps({"question": fields["question"], "answer": " ".join(body.split()[:20])}, ensure_ascii=False) + "\n```"
        return ""


class Window:
    """Calls in flight at once, at most `size`, whose results come in the order of what was asked.

    A call that fails is made again up to `retries` times, after a pause that doubles; one that takes longer than `timeout` seconds
    is given up and counts as failed (its thread ends when it ends). What fails at last gives an Exception as its result."""

    def __init__(self, size: int = 1, timeout: float | None = None, retries: int = 0, pause: float = 0.5):
        self.size, self.timeout, self.retries, self.pause = max(1, size), timeout, retries, pause

    def _start(self, call: Callable, item, wait: float) -> tuple[queue.SimpleQueue, float]:
        answer: queue.SimpleQueue = queue.SimpleQueue()

        def run() -> None:
            time.sleep(wait)
            try:
                answer.put((True, call(item)))
            except Exception as e:
                answer.put((False, e))

        threading.Thread(target=run, daemon=True).start()
        return answer, time.monotonic() + wait

    def _finish(self, call: Callable, item, answer: queue.SimpleQueue, began: float):
        for turn in range(self.retries + 1):
            try:
                left = None if self.timeout is None else max(0.0, began + self.timeout - time.monotonic())
                fine, got = answer.get(timeout=left)
            except queue.Empty:
                fine, got = False, TimeoutError(f"no answer in {self.timeout} seconds")
            if fine or turn == self.retries:
                return got
            answer, began = self._start(call, item, self.pause * 2**turn)

    def map(self, call: Callable, items: Iterable) -> Iterator:
        """What call(item) gives for each item, in order, or the Exception that it ends in."""
        flying: deque = deque()
        for item in items:
            if len(flying) == self.size:
                yield self._finish(call, *flying.popleft())
            flying.append((item, *self._start(call, item, 0.0)))
        while flying:
            yield self._finish(call, *flying.popleft())


def complete(df: DataFrame, prompt: str, out: str, factory: Callable[[], LanguageModel] = Extractive, batch: int = 20, on_error: str = "empty", window: Window | None = None) -> DataFrame:
    """df with a column `out` of a model's replies to its column `prompt`, asked `batch` at a time, and as many such requests at
    once in each task as the window lets fly. Tasks hold one window of replies, in the order of their rows; prompts alone go to Python.

    A batch that fails is asked one by one; what fails then has an empty reply (or a null one, if on_error is "null"), or stops
    the job if it is "raise". Rows with a null prompt aren't asked, and have a null reply."""
    window = window or Window()

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = factory()
        for column in columns:
            told = column.notna().to_numpy()
            prompts = column[told].tolist()
            parts = [prompts[at : at + batch] for at in range(0, len(prompts), batch)]
            replies: list = []
            for part, got in zip(parts, window.map(own.complete, parts), strict=True):
                if isinstance(got, Exception):
                    if on_error == "raise":
                        raise got
                    alone = window.map(own.complete, [[p] for p in part]) if len(part) > 1 else [got]
                    got = [("" if on_error == "empty" else None) if isinstance(x, Exception) else x[0] for x in alone]
                replies += got
            reply = np.full(len(column), None, object)
            reply[told] = [r if r is None else r.encode("utf-8", "ignore").decode() for r in replies]
            yield pd.Series(reply)

    # Not deterministic for Spark, so that no step that reads a reply twice asks for it twice.
    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, pandas_udf(run, "string").asNondeterministic()(F.col(prompt)))


#: Characters of a chunk that a filter prompt and a definition prompt show, as in the reference.
FILTER_CHARS, DEFINE_CHARS = 1000, 1500


def filter_prompt(candidates: Column, text: Column) -> Column:
    return F.concat(F.lit("task: filter\ncandidates: "), F.to_json(candidates), F.lit("\n---\n"), F.substring(text, 1, FILTER_CHARS))


def around(term: Column, text: Column, size: int) -> Column:
    """`size` characters of a text, or more for a longer term: its head if that holds the term, else those around where the
    term first stands."""
    at, n = F.instr(text, term), F.greatest(F.lit(size), F.length(term))
    start = F.greatest(F.lit(1), at - F.floor((n - F.length(term)) / 2).cast("int"))
    return F.when(at + F.length(term) - 1 <= n, F.substring(text, F.lit(1), n)).otherwise(F.substring(text, start, n))


def define_prompt(term: Column, text: Column) -> Column:
    return F.concat(F.lit("task: define\nterm: "), term, F.lit("\n---\n"), around(term, text, DEFINE_CHARS))


def parsed_terms(reply: Column) -> Column:
    """The terms of a reply; none if it isn't such an object."""
    return F.coalesce(F.from_json(reply, "terms array<string>")["terms"], F.array().cast("array<string>"))


def parsed_definition(reply: Column) -> Column:
    """term and definition of a reply, null unless it has both."""
    own = F.from_json(reply, "term string, definition string")
    return F.when(own["term"].isNotNull() & own["definition"].isNotNull(), own)
