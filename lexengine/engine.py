"""The engine: entries, indexes and vectors as tables, with the public operators over batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embed, forms, index, lookup, rerank, search, tables, validate
from .sources.connectors import embed_column
from .sources.scratch import written

#: Names, parameters with types and defaults, and descriptions of the tools.
TOOLS = (
    {"name": "search_dictionary", "params": [{"name": "query", "type": "string"}, {"name": "top_k", "type": "integer", "default": 10}, {"name": "use_reranker", "type": "boolean", "default": False}], "description": "Semantic search; several related terms work best."},
    {"name": "lookup_word", "params": [{"name": "word", "type": "string"}, {"name": "fuzzy", "type": "boolean", "default": True}], "description": "Looks up a lemma or an inflected form."},
    {"name": "get_word_forms", "params": [{"name": "lemma", "type": "string"}], "description": "All inflected forms of a lemma."},
)
#: Hits that a search is asked for when it is to vouch for a word.
SEARCHED_HITS = 3


@dataclass
class Engine:
    entries: DataFrame
    lemmas: DataFrame
    forms: DataFrame
    vectors: DataFrame
    embedder: Callable[[list[str]], np.ndarray]
    reranker: Callable[[str, list[str]], list[tuple[int, float]]] | None = None
    query_prefix: str = ""

    @classmethod
    def build(cls, entries: DataFrame, embedder: Callable, reranker: Callable | None = None, form_rows: DataFrame | None = None) -> Engine:
        """Indexes and vectors from entries, written to scratch tables for the queries to come (``sources.scratch.clear`` removes them).

        form_rows (pos, word, form) stands in for forms documents.
        """
        lemmas = written(index.lemma_index(entries), "lemmas")
        form_table = written(index.form_index(form_rows if form_rows is not None else index.exploded_forms(entries)), "forms")
        vectors = written(embed.build(entries, embedder).select("pos", "embedding"), "vectors")
        return cls(entries, lemmas, form_table, vectors, embedder, reranker)

    def views(self) -> None:
        """Registers the tables, the path function and the lookup tools as table functions for SQL."""
        for name, table in (("entries", self.entries), ("lemma_index", self.lemmas), ("form_index", self.forms), ("embeddings", self.vectors)):
            table.createOrReplaceTempView(name)
        forms.register(self.entries.sparkSession)
        tables.register(self.entries.sparkSession)

    def search_dictionary(self, queries: DataFrame, top_k: int = 10, use_reranker: bool = False, candidates: int = 100) -> DataFrame:
        """Hits of queries (qid, query): qid, rank, word, de, en."""
        vectors = embed_column(queries.withColumn("query_text", F.concat(F.lit(self.query_prefix), "query")), "query_text", self.embedder, into="vector")
        if not use_reranker or self.reranker is None or candidates == 0:
            return search.search(vectors, self.vectors, self.entries, top_k).select("qid", "rank", "word", "de", "en")
        hits = search.search(vectors, self.vectors, self.entries, candidates)
        return rerank.two_stage(hits, self.entries, queries, self.reranker, top_k, candidates).select("qid", "rank", "word", "de", "en")

    def lookup_word(self, words: DataFrame) -> DataFrame:
        """Hits of words (qid, word, fuzzy) with paths of the matched form."""
        return forms.with_paths(lookup.described(lookup.lookup(words, self.lemmas, self.forms), self.entries))

    def get_word_forms(self, words: DataFrame, compat: bool = False) -> DataFrame:
        return forms.word_forms(words, self.entries, self.lemmas, self.forms, compat)

    def validate(self, sentences: DataFrame, by_search: bool = False) -> DataFrame:
        """valid and issues of sentences (qid, sentence); with ``by_search`` a token that no lookup finds is no issue if a search has hits for it."""

        def found(unknown: DataFrame) -> DataFrame:
            asked = written(unknown.withColumn("qid", F.monotonically_increasing_id()), "searched-tokens")
            hits = self.search_dictionary(asked.select("qid", F.col("token").alias("query")), SEARCHED_HITS)
            return asked.join(hits.select("qid").distinct(), "qid", "left_semi")

        return validate.validate(sentences, self.lemmas, self.forms, found if by_search else None)

    def dispatch(self, calls: DataFrame, top_k: int = 5) -> DataFrame:
        """A batch of calls (qid, name, arguments map): qid and the result as JSON, each tool's calls in one plan."""
        get = lambda k: F.try_element_at("arguments", F.lit(k))
        listed = lambda rows, *cols: rows.groupBy("qid").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*cols).alias("row")))), lambda x: x["row"])).alias("result"))
        search_ = calls.where(F.col("name").isin("search_dictionary", "search")).select("qid", get("query").alias("query"))
        look = calls.where(F.col("name").isin("lookup_word", "lookup")).select("qid", get("word").alias("word"), F.coalesce(get("fuzzy"), F.lit("true")).cast("boolean").alias("fuzzy"))
        record = calls.where(F.col("name").isin("get_word_forms", "get_forms")).select("qid", get("lemma").alias("word"))
        check = calls.where("name = 'validate'").select("qid", get("sentence").alias("sentence"))
        found = listed(self.search_dictionary(search_, top_k), "word", "de", "en").unionByName(listed(self.lookup_word(look).where("rank <= 10"), "word", "de", "en", "gender", "matched_form", "matched_paths"))
        whole = lambda rows: rows.select("qid", F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "qid"])).alias("result"))
        found = found.unionByName(whole(self.get_word_forms(record))).unionByName(whole(self.validate(check)))
        known = F.col("name").isin("search_dictionary", "search", "lookup_word", "lookup", "get_word_forms", "get_forms", "validate")
        missing = F.when(known, F.lit("[]")).otherwise(F.to_json(F.struct(F.concat(F.lit("Unknown tool: "), "name").alias("error"))))
        return calls.join(found, "qid", "left").select("qid", F.coalesce("result", missing).alias("result"))

    def call_tool(self, name: str, arguments: dict) -> list[dict] | dict:
        """One tool call, by name; results are rows as dictionaries without empty keys."""
        spark: SparkSession = self.entries.sparkSession
        plain = lambda rows, drop=(): [{k: v for k, v in r.asDict(True).items() if v is not None and k not in drop} for r in rows]
        if name in ("search_dictionary", "search"):
            asked = spark.createDataFrame([(0, str(arguments["query"]))], "qid bigint, query string")
            found = self.search_dictionary(asked, int(arguments.get("top_k", 10)), bool(arguments.get("use_reranker", False)))
            return plain(found.orderBy("rank").collect(), ("qid", "rank"))
        if name in ("lookup_word", "lookup"):
            asked = spark.createDataFrame([(0, str(arguments["word"]), bool(arguments.get("fuzzy", True)))], "qid bigint, word string, fuzzy boolean")
            return plain(self.lookup_word(asked).orderBy("rank").limit(10).collect(), ("qid", "rank", "stage", "pos"))
        if name in ("get_word_forms", "get_forms"):
            asked = spark.createDataFrame([(0, str(arguments["lemma"]))], "qid bigint, word string")
            return plain(self.get_word_forms(asked).collect(), ("qid",))[0]
        if name == "validate":
            asked = spark.createDataFrame([(0, str(arguments["sentence"]))], "qid bigint, sentence string")
            return plain(self.validate(asked).collect(), ("qid",))[0]
        return {"error": f"Unknown tool: {name}"}
