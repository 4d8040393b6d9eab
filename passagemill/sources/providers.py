"""Models behind one seam: each provider takes a DataFrame and adds a column.

The defaults are deterministic stand-ins made of Column expressions, so that plans run without
a network or a model; they do not have a neural model's quality.  A real model plugs in as a
function whose body is a pandas UDF or mapInArrow.
"""

from __future__ import annotations

import json
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.answers import term_list
from passagemill.functions.text import tokens
from passagemill.functions.vectors import hashed_text, let


def _share(q: Column, p: Column) -> Column:
    """The share of q's distinct elements that p has."""
    return let(F.array_distinct(q), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, p)) / F.size(x)).otherwise(0.0))


def _pairs(words: Column) -> Column:
    """Neighbouring words, zipped with themselves moved on by one."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def embed_words(df: DataFrame) -> DataFrame:
    """df (text) with vector."""
    return df.withColumn("vector", hashed_text(F.col("text")))


def no_expansion(questions: DataFrame) -> DataFrame:
    """questions (qid, question) with expansion."""
    return questions.withColumn("expansion", F.lit(""))


def cheap_overlap(pool: DataFrame) -> DataFrame:
    """pool (query, text) with cheap: the share of the query's distinct tokens that the passage has."""
    return pool.withColumn("cheap", F.round(_share(tokens(F.col("query")), tokens(F.col("text"))), 6))


def lexical_logit(pool: DataFrame) -> DataFrame:
    """pool (query, text) with score: -6 without a common token, up to 6 with all tokens and pairs of tokens."""
    words = F.array(F.struct(tokens(F.col("query")).alias("q"), tokens(F.col("text")).alias("p")))
    score = F.transform(words, lambda w: 10 * _share(w["q"], w["p"]) + 2 * _share(_pairs(w["q"]), _pairs(w["p"])) - 6)
    return pool.withColumn("score", F.round(F.element_at(score, 1), 6))


def extract_answer(asked: DataFrame) -> DataFrame:
    """asked (question, context, kept) with answer: the best passage's first 300 characters and its chapter."""
    best = F.element_at("kept", 1)
    return asked.withColumn("answer", F.concat(F.substring(best["text"], 1, 300), F.lit(" ["), best["chapter"], F.lit("]")))


def lexical_judge(answered: DataFrame) -> DataFrame:
    """answered (question, context, answer) with reply, a judge's JSON: grounded if the context has the answer's first 40 characters, answering if the answer has half of the question's distinct tokens."""
    grounded = F.contains("context", F.substring("answer", 1, 40))
    answers = F.round(_share(tokens(F.col("question")), tokens(F.col("answer"))), 6) >= 0.5
    return answered.withColumn("reply", F.to_json(F.struct(grounded.alias("grounded"), answers.alias("answers"), F.lit("").alias("problem"))))


@dataclass(frozen=True)
class Providers:
    embed_query: Callable[[DataFrame], DataFrame] = embed_words
    embed_documents: Callable[[DataFrame], DataFrame] = embed_words
    expand: Callable[[DataFrame], DataFrame] = no_expansion
    prefilter: Callable[[DataFrame], DataFrame] = cheap_overlap
    rerank: Callable[[DataFrame], DataFrame] = lexical_logit
    answer: Callable[[DataFrame], DataFrame] = extract_answer
    judge: Callable[[DataFrame], DataFrame] = lexical_judge


_warned: set[str] = set()


def _warn_once(message: str, kind: str = "expansion") -> None:
    if kind not in _warned:
        _warned.add(kind)
        warnings.warn(message, stacklevel=2)


def _post(url: str, body: dict, timeout: float) -> dict:
    data = json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as r:
        return json.loads(r.read())


def http_embedder(url: str, prefix: str = "", batch: int = 32, timeout: float = 120) -> Callable[[DataFrame], DataFrame]:
    """An embedding service: texts are sent in batches by length, answers put back by their index; an error fails the task."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            order = texts.fillna("").str.len().argsort(kind="stable")
            out: list = [None] * len(texts)
            for lo in range(0, len(texts), batch):
                at = order.iloc[lo : lo + batch].tolist()
                got = _post(f"{url}/embeddings", {"input": [prefix + (texts.iloc[i] or "") for i in at]}, timeout)["data"]
                for row in got:
                    out[at[row["index"]]] = row["embedding"]
            yield pd.Series(out)

    def add(df: DataFrame) -> DataFrame:
        embed = F.pandas_udf(run, "array<float>")
        return df.withColumn("vector", embed("text"))

    run.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return add


def http_expander(url: str, model: str, prompt: str, timeout: float = 15) -> Callable[[DataFrame], DataFrame]:
    """A chat service that lists search terms; whatever goes wrong, the expansion is empty, with one warning a process."""

    def run(questions: pd.Series) -> pd.Series:
        def one(q: str) -> str:
            body = {"model": model, "temperature": 0, "max_tokens": 100, "stream": False, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": q}]}
            try:
                return _post(f"{url}/chat/completions", body, timeout)["choices"][0]["message"]["content"] or ""
            except Exception as e:
                _warn_once(f"no expansion: {e}")
                return ""

        return questions.map(one)

    run.__annotations__ = {"questions": pd.Series, "return": pd.Series}

    def add(df: DataFrame) -> DataFrame:
        return df.withColumn("expansion", term_list(F.pandas_udf(run, "string")("question")))

    return add


def http_reranker(url: str, timeout: float = 120) -> Callable[[DataFrame], DataFrame]:
    """A reranking service: one call for each query's passages in a batch, scores put back by index."""

    def run(queries: pd.Series, passages: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(queries), dtype=object)
        for q, at in queries.groupby(queries).groups.items():
            at = list(at)
            for row in _post(f"{url}/rerank", {"query": q, "documents": passages[at].tolist()}, timeout)["results"]:
                out[at[row["index"]]] = float(row["relevance_score"])
        return out.astype(float)

    run.__annotations__ = {"queries": pd.Series, "passages": pd.Series, "return": pd.Series}

    def add(df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.pandas_udf(run, "double")("query", "text"))

    return add


def http_answerer(url: str, model: str, prompt: str, timeout: float = 120) -> Callable[[DataFrame], DataFrame]:
    """A chat service that answers from the context; an error fails the task."""

    def run(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(q: str, c: str) -> str:
            body = {"model": model, "temperature": 0.2, "stream": False, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": f"Passages:\n{c}\n\nQuestion: {q}"}]}
            return _post(f"{url}/chat/completions", body, timeout)["choices"][0]["message"]["content"]

        return pd.Series([one(q, c) for q, c in zip(questions, contexts)])

    run.__annotations__ = {"questions": pd.Series, "contexts": pd.Series, "return": pd.Series}

    def add(df: DataFrame) -> DataFrame:
        return df.withColumn("answer", F.pandas_udf(run, "string")("question", "context"))

    return add


def http_judge(url: str, model: str, prompt: str, timeout: float = 120) -> Callable[[DataFrame], DataFrame]:
    """A chat service that judges answers; a reply that is no verdict counts as an error of the judge's, and so does a call that fails."""

    def run(questions: pd.Series, contexts: pd.Series, answers: pd.Series) -> pd.Series:
        def one(q: str, c: str, a: str) -> str:
            said = f"Passages:\n{c}\n\nQuestion: {q}\n\nAnswer: {a}"
            body = {"model": model, "temperature": 0, "stream": False, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": said}]}
            try:
                return _post(f"{url}/chat/completions", body, timeout)["choices"][0]["message"]["content"] or ""
            except Exception as e:
                _warn_once(f"no verdict: {e}", "judge")
                return ""

        return pd.Series([one(q, c, a) for q, c, a in zip(questions, contexts, answers)])

    run.__annotations__ = {"questions": pd.Series, "contexts": pd.Series, "answers": pd.Series, "return": pd.Series}

    def add(df: DataFrame) -> DataFrame:
        return df.withColumn("reply", F.pandas_udf(run, "string")("question", "context", "answer"))

    return add
