"""Retrieval: chunks, full-text and vector search, their merge, and evidence.

Searches take a table of queries, not one: chunks and queries meet by an equi-join
on terms (text) or in blocks (vectors), so many queries cost one pass.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as t
from ..shared import shared_folder
from . import nearest

MAX_CHARS, OVERLAP = 1400, 180
BREAK = 0.65
LEAST_CANDIDATES = 8
TEXT_WEIGHT, VECTOR_WEIGHT, BOTH_BONUS = 0.45, 0.55, 0.05


def chunk(pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, document: str = "document_id", page: str = "page", text: str = "text") -> DataFrame:
    """document_id, chunk_index, page, content: windows that end at a space where one is near, and overlap.

    ``overlap`` must be less than the shortest window that breaks at a space, else
    windows might not move on. Blank pages have no chunks.
    """
    if not 0 <= overlap < int(max_chars * BREAK):
        raise ValueError("overlap must be less than 0.65 of max_chars")
    key = pages.schema[document]

    def cut(batches):
        import pyarrow as pa

        least = int(max_chars * BREAK)
        for batch in batches:
            docs, numbers, texts = (batch.column(c).to_pylist() for c in ("d", "p", "x"))
            out: list[tuple] = []
            for d, p, x in zip(docs, numbers, texts, strict=True):
                start, n = 0, 0
                while start < len(x):
                    end = min(start + max_chars, len(x))
                    if end < len(x) and (space := x.rfind(" ", start, end)) > start + least:
                        end = space
                    if piece := x[start:end].strip():
                        out.append((d, p, n, piece))
                        n += 1
                    if end >= len(x):
                        break
                    start = max(0, end - overlap)
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("d").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["document_id", "page", "n", "content"])

    schema = T.StructType([T.StructField("document_id", key.dataType), T.StructField("page", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("content", T.StringType())])
    rows = pages.select(F.col(document).alias("d"), F.col(page).cast("int").alias("p"), F.trim(F.regexp_replace(t.text(text), r"\s+", " ")).alias("x"))
    order = Window.partitionBy("document_id").orderBy("page", "n")
    return rows.mapInArrow(cut, schema).withColumn("chunk_index", F.row_number().over(order) - 1).drop("n")


def terms(x: Column) -> Column:
    """Search terms of normalised text, as the "simple" configuration has them: letters and digits, nothing removed."""
    return F.filter(F.split(t.normalize_ascii(x), "[^a-z0-9]+"), lambda w: w != "")


def postings(chunks: DataFrame) -> DataFrame:
    """term, document_id, chunk_index: the inverted index of chunks."""
    return chunks.select("document_id", "chunk_index", F.explode(F.array_distinct(terms(F.col("content")))).alias("term"))


def text_matches(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, document_id, chunk_index of chunks that have all terms of a query (query_id, query).

    Chunks are explicit postings joined on terms; a count of distinct terms says
    whether all are there.
    """
    asked = queries.select("query_id", F.array_distinct(terms(F.col("query"))).alias("q")).where(F.size("q") > 0)
    one = asked.select("query_id", F.size("q").alias("need"), F.explode("q").alias("term"))
    found = postings(chunks).join(one, "term").groupBy("query_id", "need", "document_id", "chunk_index").agg(F.count("*").alias("have"))
    return found.where(F.col("have") == F.col("need")).select("query_id", "document_id", "chunk_index")


def cover_density():
    """UDF: rank of a chunk for all terms of a query by its covers (Clarke, Cormack and Tudhope).

    Each shortest span that holds all terms adds 1 / (1 + noise), noise being the
    words in it that aren't terms, times 0.1 for terms of unlabelled weight.
    """

    @F.pandas_udf("double")
    def run(words, query):
        import pandas as pd

        def one(w, q):
            q = set(q)
            last: dict = {}  # place in the text and among the terms of each term's last occurrence
            total, begin_before, n = 0.0, -1, 0
            for i, x in enumerate(w):
                if x in q:
                    last[x] = (i, n)
                    if len(last) == len(q):
                        begin, first = min(last.values())
                        if begin > begin_before:
                            total += 0.1 / (1 + (i - begin) - (n - first))
                            begin_before = begin
                    n += 1
            return total

        return pd.Series([one(w, q) for w, q in zip(words, query, strict=True)])

    return run


def text_search(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The best chunks of each query by cover density (to nine places, so sums in another order are equal); ties by document, page and place."""
    met = text_matches(chunks, queries).join(chunks, ["document_id", "chunk_index"]).join(queries, "query_id")
    ranked = met.withColumn("score", F.round(cover_density()(terms(F.col("content")), F.array_distinct(terms(F.col("query")))), 9))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "page", "chunk_index")
    return ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).drop("query")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


#: Queries that one scan of the vectors answers.
QUERY_BLOCK = 4096


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, key, score: exact cosine of each query (query_id, q) with every vector of its length; best first.

    A stated set of queries goes against all rows in blocks: the driver holds ``block``
    queries at a time and sends them to all tasks, which keep their own best rows of
    each query, so a block's shuffle has at most ``limit`` rows for each query and
    task. The results of several blocks are written to the shared folder one by one.
    Null, empty and zero vectors have no score; ties go to the smaller key.
    """
    spark = vectors.sparkSession
    types = {f.name: f.dataType for f in [*vectors.schema, *queries.schema]}
    schema = T.StructType([T.StructField("query_id", types["query_id"]), T.StructField(key, types[key]), T.StructField("score", T.DoubleType())])
    rows = vectors.where(F.size(vector) > 0).select(F.col(key).alias("_k"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)

    def answers(some: list) -> DataFrame:
        found = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(some), limit, to_arrow_schema(schema)), schema)
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", key, "score", "place")

    asked = iter(queries.where(F.size("q") > 0).select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q")).toLocalIterator())
    some = [tuple(r) for r in itertools.islice(asked, block)]
    more = [tuple(r) for r in itertools.islice(asked, block)]
    if not more:
        return answers(some)
    at = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    while some:
        answers(some).write.mode("append").parquet(at)
        some, more = more, [tuple(r) for r in itertools.islice(asked, block)]
    return spark.read.parquet(at)


def _nearest(sent, limit: int, schema):
    """The rows of a task that are among its nearest to each query of a block."""

    def run(batches):
        import pyarrow as pa

        asked = nearest.by_length(sent.value)
        best = nearest.Best(len(sent.value), limit)
        for batch in batches:
            for rows, v in nearest.matrices(batch.column("_v")):
                if v.shape[1] in asked:
                    which, q = asked[v.shape[1]]
                    best.add(which, batch.column("_k").take(pa.array(rows)), nearest.scores(v, q))
        yield from nearest.answers(best, [r[0] for r in sent.value], schema)

    return run


def merge_hits(text_hits: DataFrame, vector_hits: DataFrame, limit: int, keys: tuple[str, ...] = ("document_id", "chunk_index"), ties: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge of hits (query_id, keys, score): each side by its greatest score, weighted, a bonus for both.

    Ties are broken by all keys descending, then ``ties`` descending.
    """
    on = ["query_id", *keys]
    a = text_hits.select(*on, F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("text_score"), F.lit(True).alias("_t"))
    b = vector_hits.select(*on, F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("vector_score"), F.lit(True).alias("_v"))
    d = a.join(b, on, "full_outer").na.fill(0.0, ["text_score", "vector_score"])
    whole = Window.partitionBy("query_id")
    part = lambda c: F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)).otherwise(0.0)
    d = d.withColumn("_a", part("text_score")).withColumn("_b", part("vector_score"))
    total = F.col("_a") * TEXT_WEIGHT + F.col("_b") * VECTOR_WEIGHT + F.when((F.col("_a") > 0) & (F.col("_b") > 0), BOTH_BONUS).otherwise(0.0)
    mode = F.when(F.col("_t") & F.col("_v"), "hybrid").when(F.col("_t"), "text").otherwise("vector")
    d = d.withColumn("score", F.bround(total, 6)).withColumn("retrieval_mode", mode)
    best = Window.partitionBy("query_id").orderBy(*(F.desc(c) for c in ("score", "vector_score", "text_score", *ties, *keys)))
    return d.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).drop("_a", "_b", "_t", "_v")


def search(chunks, queries: DataFrame, limit: int = 5, mode: str = "auto", vector_hits: DataFrame | None = None) -> DataFrame:
    """Text, vector, hybrid or auto search: each side gives max(2 * limit, 8) hits.

    ``chunks`` is a table or a stored index of it (``TextIndex``). In mode auto a query
    without vector hits is answered by text alone.
    """
    over = max(2 * limit, LEAST_CANDIDATES)
    keep = ["query_id", "document_id", "chunk_index", "score", "text_score", "vector_score", "retrieval_mode", "place"]
    if mode == "vector":
        return vector_hits.where(F.col("place") <= limit).withColumns({"text_score": F.lit(0.0), "vector_score": F.col("score"), "retrieval_mode": F.lit("vector")}).select(*keep)
    found = text_search(chunks, queries, over) if isinstance(chunks, DataFrame) else chunks.search(queries, over)
    alone = found.where(F.col("place") <= limit).withColumns({"text_score": F.col("score"), "vector_score": F.lit(0.0), "retrieval_mode": F.lit("text")}).select(*keep)
    if mode == "text" or vector_hits is None:
        return alone
    both = merge_hits(found, vector_hits.where(F.col("place") <= over), limit)
    if mode == "hybrid":
        return both.select(*keep)
    with_vectors = vector_hits.select("query_id").distinct()
    return both.join(with_vectors, "query_id", "left_semi").select(*keep).unionByName(alone.join(with_vectors, "query_id", "left_anti"))


def candidate_query(*values: Column) -> Column:
    """The first 18 distinct tokens of a part, its vehicle and a candidate."""
    return F.array_join(F.slice(t.long_tokens(*values), 1, 18), " ")


SUMMARIES = {
    "year_scope_warning": "Catalogo tecnico sugiere otra ventana de anos; validar modelo.",
    "reference_supported": "Catalogo tecnico respalda referencia o aplicacion del vehiculo.",
    "vehicle_supported": "Fuente tecnica respalda la aplicacion para este vehiculo.",
    "generic_support": "Fuente tecnica describe esta familia; validar referencia exacta.",
}


def evidence(asked: DataFrame, hits: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, verdict, summary, citations: what a candidate's hits say, in their order.

    ``asked`` has query_id, asked_reference, candidate_reference, candidate_brand,
    part_name, vehicle_brand, vehicle_line, year; ``hits`` query_id, place, content,
    title, page, score, retrieval_mode. A later verdict replaces an earlier one,
    except that general support only counts if there was none.
    """
    n = lambda c: t.normalize_ascii(F.col(c))
    d = hits.where(F.col("place") <= limit).join(asked, "query_id")
    content = n("content")
    own = t.long_tokens(F.col("content"))
    vehicle = F.size(F.array_intersect(F.array_union(t.long_tokens(F.col("vehicle_brand")), t.long_tokens(F.col("vehicle_line"))), own))
    part = F.size(F.array_intersect(t.long_tokens(F.col("part_name")), own))
    inside = lambda c: (n(c) != "") & content.contains(n(c))
    reference = inside("asked_reference") | inside("candidate_reference")
    seen, year = t.years(content, swap=False, most=None), t.strict_int(F.col("year"))
    other_years = F.coalesce(year > 0, F.lit(False)) & (F.size(seen) > 0) & ~F.array_contains(seen, year.cast("int"))
    verdict = (
        F.when(other_years & (reference | (vehicle >= 2)), "year_scope_warning")
        .when(reference & (vehicle >= 1), "reference_supported")
        .when((vehicle >= 2) & (part >= 1), "vehicle_supported")
        .when((part >= 2) | inside("candidate_brand"), "generic_support")
    )
    cited = F.struct(F.col("title"), t.page_span(F.col("page"), F.col("page")).alias("page_span"), F.bround("score", 4).alias("score"), "retrieval_mode")
    g = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", verdict.alias("v"), cited.alias("c")))).alias("h"))

    def step(now: Column, h: Column) -> Column:
        return F.when(h["v"].isNull() | ((h["v"] == "generic_support") & (now != "no_evidence")), now).otherwise(h["v"])

    g = g.withColumn("verdict", F.aggregate("h", F.lit("no_evidence"), step))
    summary = F
    for v, s in SUMMARIES.items():
        summary = summary.when(F.col("verdict") == v, s)
    cites = F.when(F.col("verdict") != "no_evidence", F.slice(F.transform("h", lambda h: h["c"]), 1, 3)).otherwise(F.slice(F.transform("h", lambda h: h["c"]), 1, 0))
    return asked.select("query_id").join(g.select("query_id", "verdict", summary.alias("summary"), cites.alias("citations")), "query_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("no_evidence")))
