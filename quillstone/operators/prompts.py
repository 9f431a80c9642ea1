"""Prompts and traces of model calls. A model is any function from a prompt column to an answer column; the mock needs no network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The texts of prompts and of the mock.
CONTEXT = "Use the following context to answer questions:\n\n"
EXPLAIN = ("Explain what this ", " code does:\n\n```", "\n```\n\nProvide a clear, concise explanation of:\n1. What the code does\n2. Key functions or classes\n3. Important patterns or algorithms used")
IMPROVE = ("Review this ", " code and suggest improvements:\n\n```", "\n```\n\nFocus on:\n1. Code quality and readability\n2. Performance optimizations\n3. Best practices\n4. Potential bugs or issues")
ARCHITECTURE = "Based on the file summaries provided, analyze the overall architecture:\n\n1. What is the main purpose of this codebase?\n2. What are the key components/modules?\n3. How do the components interact?\n4. What architectural patterns are used?\n5. What technology stack is being used?"
SUMMARIES = "File summaries:\n"
MOCK, MOCK_TOKENS = ("Mock response to: ", "..."), {"prompt_tokens": 50, "completion_tokens": 25, "total_tokens": 75}
TRACE = "request_id string, start_time timestamp, end_time timestamp, prompt string, content string, total_tokens long, error string"


def _about(texts: tuple[str, str, str], code: Column, language: Column) -> Column:
    return F.concat(F.lit(texts[0]), language, F.lit(texts[1]), language, F.lit("\n"), code, F.lit(texts[2]))


def explain(code: Column, language: Column) -> Column:
    return _about(EXPLAIN, code, language)


def improve(code: Column, language: Column) -> Column:
    return _about(IMPROVE, code, language)


def summaries_context(files: DataFrame, by: list[str], path: str = "path", summary: str = "summary", most: int | None = None) -> DataFrame:
    """(by, context) for ARCHITECTURE: a line for each file by path, or for the first ``most`` where a prompt takes no more."""
    first = files.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(path)))
    first = first if most is None else first.where(F.col("rank") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("\n"), path, F.lit(": "), summary).alias("l")))), lambda x: x["l"])
    return first.groupBy(*by).agg(F.concat(F.lit(SUMMARIES), F.array_join(lines, "")).alias("context"))


def messages(question: Column, context: Column | None = None) -> Column:
    """The messages of a question: a system message if there is context, then the question."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = F.array(one("user", question))
    return asked if context is None else F.when(context.isNotNull() & (context != ""), F.concat(F.array(one("system", F.concat(F.lit(CONTEXT), context))), asked)).otherwise(asked)


def mock(said: Column) -> Column:
    """The mock's answer to messages: the first 100 characters of the last user message."""
    user = F.filter(said, lambda m: m["role"] == "user")
    last = F.coalesce(F.try_element_at(user, F.lit(-1))["content"], F.lit("No user message"))
    return F.concat(F.lit(MOCK[0]), F.substring(last, 1, 100), F.lit(MOCK[1]))


def model(kind: str, call: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """The function that answers messages: "mock", or "hook" with a function of one's own. Providers are not part of the engine."""
    if kind == "mock":
        return mock
    if kind == "hook" and call is not None:
        return call
    raise ValueError(f"unsupported model type: {kind}")


def ask(rows: DataFrame, answers: Callable[[Column], Column], question: str = "question", context: str | None = None) -> DataFrame:
    """``rows`` with the answer of a model to each question."""
    return rows.withColumn("answer", answers(messages(F.col(question), F.col(context) if context else None)))


def traces(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Starts (request_id, start_time, prompt) with their ends (request_id, end_time, content, total_tokens, error); the last end of a request
    counts, ends without a start are left out, and a request without an end stays open."""
    last = ends.groupBy("request_id").agg(F.max_by(F.struct("end_time", "content", "total_tokens", "error"), F.struct("end_time", "content")).alias("e"))
    met = starts.join(last, "request_id", "left").select("request_id", "start_time", F.col("e.end_time").alias("end_time"), "prompt", F.col("e.content").alias("content"), F.col("e.total_tokens").alias("total_tokens"), F.col("e.error").alias("error"))
    return met.withColumn("duration_ms", F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / F.lit(1000.0))


def trace_stats(made: DataFrame) -> DataFrame:
    """One row: requests, successes, failures, tokens of successes."""
    ended, failed = F.col("end_time").isNotNull(), F.col("error").isNotNull() & (F.col("error") != "")
    return made.agg(F.count(F.lit(1)).alias("requests"), F.count_if(ended & ~failed).alias("successes"), F.count_if(failed).alias("failures"), F.coalesce(F.sum(F.when(ended & ~failed, F.col("total_tokens"))), F.lit(0)).cast("bigint").alias("tokens"))


def save_traces(made: DataFrame, path: str | None) -> None:
    """Write traces as JSON lines with their statistics beside them; nothing without a path."""
    if path:
        made.write.mode("overwrite").json(f"{path}/traces")
        trace_stats(made).write.mode("overwrite").json(f"{path}/stats")


def get_trace(made: DataFrame, request_id: str) -> DataFrame:
    return made.where(F.col("request_id") == request_id)
