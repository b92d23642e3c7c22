"""Tool-calling conversations: assembling streams, parsing calls, used words, context, histories, and the staged pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def assemble_calls(fragments: DataFrame) -> DataFrame:
    """Calls from fragments (stream_id, idx, seq, id, name, arguments): arguments concatenated in order, the last id and name that aren't empty."""
    last = lambda c: F.max_by(c, F.when(F.length(c) > 0, F.col("seq")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a")))), lambda x: x["a"])
    return fragments.groupBy("stream_id", "idx").agg(last("id").alias("id"), last("name").alias("name"), F.array_join(parts, "").alias("arguments"))


def assemble_content(deltas: DataFrame) -> DataFrame:
    """content and reasoning of each stream and turn from deltas (stream_id, turn, seq, kind, piece)."""
    joined = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "piece")))), lambda x: x["piece"]), "")
    return deltas.groupBy("stream_id", "turn").agg(joined("content").alias("content"), joined("reasoning").alias("reasoning"))


def routed(events: DataFrame) -> DataFrame:
    """Adds the kind of each delta (content, reasoning, tool_call) or its end (done, error); rows without data are left out."""
    kind = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("finish").isNotNull(), "done").when(F.length("tool_call") > 0, "tool_call_delta")
        .when(F.length("reasoning") > 0, "reasoning_delta").when(F.length("content") > 0, "content_delta")
    )
    return events.withColumn("event_type", kind).where("event_type IS NOT NULL")


def distinct_calls(calls: DataFrame) -> DataFrame:
    """The first of equal calls (conv_id, n, name, arguments) of a conversation."""
    return calls.withColumn("_r", F.row_number().over(W.partitionBy("conv_id", "name", "arguments").orderBy("n"))).where("_r = 1").drop("_r")


def repeats(rows: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Adds streak, how often the value has come in a row up to this row."""
    w = W.partitionBy(key).orderBy(*order)
    starts = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    grouped = rows.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(w))
    return grouped.withColumn("streak", F.row_number().over(W.partitionBy(key, "_island").orderBy(*order))).drop("_start", "_island")


def used_words(results: DataFrame, tools: tuple[str, ...], distinct: bool = True) -> DataFrame:
    """Words that the named tools returned by conversation, in order; distinct or as often as they came.

    results (conv_id, n, name, word).
    """
    rows = results.where(F.col("name").isin(*tools) & F.col("word").isNotNull())
    if distinct:
        rows = rows.groupBy("conv_id", "word").agg(F.min("n").alias("n"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))


def context(results: DataFrame, rows_per_call: int = 5) -> DataFrame:
    """Results (conv_id, call, asked, rank, word, de, en) as lines of context, at most five rows of each call."""
    line = F.concat(F.lit("  "), F.col("word"), F.lit(" ["), F.coalesce("de", F.lit("")), F.lit("] ("), F.coalesce("en", F.lit("")), F.lit(")"))
    rows = results.where(F.col("rank") <= rows_per_call).select("conv_id", "call", "rank", line.alias("line"))
    heads = results.select("conv_id", "call", F.lit(0).alias("rank"), F.concat(F.lit('search "'), "asked", F.lit('":')).alias("line")).distinct()
    return rows.unionByName(heads).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("call", "rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


def history(messages: DataFrame) -> DataFrame:
    """Each conversation's messages as one text, by turn."""
    line = F.concat("role", F.lit(": "), "text")
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"), F.count(F.lit(1)).alias("turns"))


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (id, sent, method) with their responses (id, received, result); works on streams too, with watermarks on sent and received."""
    return requests.join(responses.withColumnRenamed("id", "response_id"), (F.col("id") == F.col("response_id")) & (F.col("received") >= F.col("sent")) & (F.col("received") <= F.col("sent") + F.expr("INTERVAL 30 SECONDS"))).drop("response_id")


def gloss(tokens: DataFrame, hits: DataFrame) -> DataFrame:
    """Each token's German gloss, or the token itself; tokens (qid, n, token), hits (qid, token, de)."""
    first = hits.groupBy("token").agg(F.min_by("de", F.col("rank")).alias("de"))
    return tokens.join(first, "token", "left").select("qid", "n", "token", F.coalesce(F.nullif(F.col("de"), F.lit("")), "token").alias("gloss"))


def tool_descriptions(tools: DataFrame) -> DataFrame:
    """One line per tool: - name(p: type = default): description; tools (n, name, params array, description)."""
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(": "), p["type"], F.when(p["default"].isNotNull(), F.concat(F.lit(" = "), p["default"])).otherwise(""))), ", ")
    line = F.concat(F.lit("- "), "name", F.lit("("), params, F.lit("): "), F.trim(F.regexp_replace("description", r"\s+", " ")))
    return tools.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("tools"))


def generate(model: Callable[[list[dict]], str], call_tool: Callable[[str, dict], object], system: str, user: str, parse: Callable[[str], list[dict]], most: int = 10, repeats_allowed: int = 2) -> tuple[str, list[dict]]:
    """A model's answer after at most ``most`` rounds of tool calls, and the calls; stops when the same calls come again twice.

    This loop is a dialogue with one model and holds no tables.
    """
    messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    done: list[dict] = []
    seen: set[str] = set()
    same = 0
    answer = ""
    for _ in range(most):
        answer = model(messages)
        calls = [c for c in parse(answer) if repr(sorted(c.items(), key=str)) not in seen]
        if not parse(answer):
            break
        same = 0 if calls else same + 1
        if same >= repeats_allowed:
            break
        results = []
        for c in calls:
            seen.add(repr(sorted(c.items(), key=str)))
            done.append(c)
            results.append({"name": c["name"], "result": call_tool(c["name"], c.get("arguments", {}))})
        messages += [{"role": "assistant", "content": answer}, {"role": "user", "content": str(results)}]
    return answer, done


def staged_answer(question: str, understand: Callable[[str], list[str]], plan: Callable[[str], str], search: Callable[[str], list[dict]], final: Callable[[str], str], words_of: Callable[[str], list[str]]) -> str:
    """Understand, plan, search, answer: the four phases with injected functions."""
    glossed = " ".join(understand(question))
    words = words_of(plan(glossed))
    lines = [f'search "{w}":\n' + "\n".join(f"  {r['word']} [{r['de']}] ({r['en']})" for r in search(w)[:5]) for w in words]
    return final("\n".join(lines))
