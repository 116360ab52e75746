"""Hybrid search over files, chunks and vectors (FI1-FI8, JN1-JN10, AG1-AG4, AG10, WN1, WN2, TK1-TK7, MA1-MA3, ST7).

Candidates are the best 50 files by BM25 and the files of the 50 nearest chunks, both cut before any filter; the
ranks are fused, and only then do live state, types, confidence, dates and scope filter, so a filter can return
fewer rows than exist. `prefilter=True` filters before the cuts instead. Ties of ranks go by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars, text
from quarry.operators.postings import COLUMNS as FTS_COLUMNS
from quarry.operators.postings import phrase_hits

TOP, K1, B, RRF = 50, 1.2, 0.75, 60  # fixed values


@dataclass(frozen=True)
class Tables:
    roots: DataFrame
    files: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame | None = None
    sizes: DataFrame | None = None


@dataclass(frozen=True)
class SearchQuery:
    query_text: str = ""
    media_types: tuple[str, ...] = ()
    root_scope: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    min_confidence: float = 0.0
    limit: int = 50
    offset: int = 0
    mode: str = "hybrid"
    cursor: str = ""


def phrase_features(files: DataFrame, phrase: list[str]) -> DataFrame:
    """(file_id, tf, size): occurrences of the phrase within single columns, and tokens over all of them."""
    cols = [text.spaced(F.coalesce(c, F.lit(""))) for c in FTS_COLUMNS]
    tf = sum((text.phrase_count(c, phrase) for c in cols[1:]), text.phrase_count(cols[0], phrase))
    size = sum((F.size(text.tokens(F.coalesce(c, F.lit("")))) for c in FTS_COLUMNS[1:]), F.size(text.tokens(FTS_COLUMNS[0])))
    return files.select(F.col("id").alias("file_id"), tf.alias("tf"), size.cast("long").alias("size"))


def corpus_stats(features: DataFrame) -> DataFrame:
    """AG10: one row of documents, documents with the phrase, and total size; deleted files count."""
    return features.agg(F.count("*").alias("n_docs"), F.count_if(F.col("tf") > 0).alias("n_hits"), F.sum("size").alias("total_size"))


def bm25(tf: Column, size: Column, n_docs: Column, n_hits: Column, total: Column) -> Column:
    """MA3: smaller is better."""
    idf = F.greatest(F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5)), F.lit(1e-6))
    return -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (total / n_docs)))


def text_hits(t: Tables, phrase: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, stats): (file_id, tf, size) of files with the phrase, and one row of corpus sums; from postings where there are some."""
    if t.postings is None:
        features = phrase_features(t.files, phrase)
        return features.where("tf > 0"), corpus_stats(features)
    hits = phrase_hits(t.postings, phrase)
    sums = t.sizes.agg(F.count("*").alias("n_docs"), F.sum("size").alias("total_size"))
    return hits, sums.join(F.broadcast(hits.agg(F.count("*").alias("n_hits"))))  # one row beside one row


def fts_ranks(t: Tables, query: str, top: int = TOP) -> DataFrame:
    """(file_id, bm25, fts_rank): the best `top` files for the query as one phrase."""
    hits, stats = text_hits(t, text.query_tokens(query))
    scored = hits.join(F.broadcast(stats))  # one row of sums
    best = scored.select("file_id", bm25(F.col("tf"), F.col("size"), F.col("n_docs"), F.col("n_hits"), F.col("total_size")).alias("bm25")).orderBy("bm25", "file_id").limit(top)
    return best.withColumn("fts_rank", F.row_number().over(Window.orderBy("bm25", "file_id")))


def l2(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def nearest_chunks(vectors: DataFrame, query: list[float], top: int = TOP) -> DataFrame:
    """TK2: exhaustive, map-side heaps of `top` rows."""
    return vectors.select("chunk_id", l2(F.col("embedding"), query).alias("distance")).orderBy("distance", "chunk_id").limit(top)


def vector_ranks(t: Tables, query: list[float], top: int = TOP) -> DataFrame:
    """(file_id, distance, best_chunk, vec_rank): the nearest chunk of each file among the nearest chunks."""
    near = F.broadcast(nearest_chunks(t.vectors, query, top))  # at most `top` rows
    mine = t.chunks.select(F.col("id").alias("chunk_id"), "file_id").join(near, "chunk_id")
    best = mine.groupBy("file_id").agg(F.min(F.struct("distance", "chunk_id")).alias("m")).select("file_id", "m.distance", F.col("m.chunk_id").alias("best_chunk"))
    return best.withColumn("vec_rank", F.row_number().over(Window.orderBy("distance", "file_id")))


def fuse(fts: DataFrame | None, vec: DataFrame | None) -> DataFrame:
    """JN7, AG3: one row per candidate file with reciprocal-rank score and both ranks."""
    if fts is None:
        both = vec.withColumns({"bm25": F.lit(None).cast("double"), "fts_rank": F.lit(None).cast("int")})
    elif vec is None:
        both = fts.withColumns({"distance": F.lit(None).cast("double"), "best_chunk": F.lit(None).cast("long"), "vec_rank": F.lit(None).cast("int")})
    else:
        both = fts.join(vec, "file_id", "full")
    term = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return both.withColumn("score", term("fts_rank") + term("vec_rank"))


def in_scope(path: Column, scope: tuple[str, ...]) -> Column:
    """FI8: a component of the root's path is one of the names, in either case."""
    return F.arrays_overlap(F.filter(F.split(F.lower(path), "/"), lambda x: x != ""), F.array(*(F.lit(s.lower()) for s in scope)))


def file_filters(q: SearchQuery) -> list[Column]:
    out = [F.col("deleted_at").isNull(), F.col("active")]
    if q.media_types:
        out.append(F.lower("media_type").isin(*(m.lower() for m in q.media_types)))
    if q.min_confidence > 0:
        out.append(F.col("confidence") >= F.lit(q.min_confidence).cast("float"))
    low, high = scalars.date_bounds(q.date_from, q.date_to)
    if low is not None:
        out.append(F.col("mtime_ns") >= low)
    if high is not None:
        out.append(F.col("mtime_ns") <= high)
    if q.root_scope:
        out.append(in_scope(F.col("root_path"), q.root_scope))
    return out


def with_roots(t: Tables) -> DataFrame:
    roots = t.roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"), "active")
    return t.files.join(roots, "root_id")


def candidates(t: Tables, q: SearchQuery, vector: list[float] | None, prefilter: bool = False) -> DataFrame:
    """All filtered candidates with score, path and ranks, before paging."""
    if prefilter:
        live = with_roots(t)
        for f in file_filters(q):
            live = live.where(f)
        t = Tables(t.roots, live.drop("root_path", "active"), t.chunks.join(live.select(F.col("id").alias("file_id")), "file_id", "left_semi"), t.vectors)
        t = Tables(t.roots, t.files, t.chunks, t.vectors.join(t.chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"))
    fts = None if q.mode == "semantic" else fts_ranks(t, q.query_text)
    if q.mode != "keyword" and vector is None:
        raise ValueError("this mode needs the query's vector")
    vec = None if q.mode == "keyword" else vector_ranks(t, vector)
    found = with_roots(t).join(F.broadcast(fuse(fts, vec).withColumnRenamed("file_id", "id")), "id")  # at most 2 * TOP rows
    for f in file_filters(q):
        found = found.where(f)
    return found.withColumn("path", F.concat_ws("/", F.regexp_replace("root_path", "/+$", ""), "rel_path"))


def page(found: DataFrame, q: SearchQuery) -> DataFrame:
    """TK3-TK5: by score, then path; a valid cursor overrides the offset."""
    limit, after = min(200, max(1, q.limit)), scalars.decode_cursor(q.cursor) if q.cursor else None
    if after:
        score, path = after
        return found.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("path") > path))).orderBy(F.desc("score"), "path").limit(limit)
    return found.orderBy(F.desc("score"), "path").offset(max(0, q.offset)).limit(limit)


def snippets(rows: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """ST7: the match where the text rank is no worse, else the start of the best chunk, else of the text."""
    best = chunks.select(F.col("id").alias("best_chunk"), F.col("text").alias("chunk_text"))
    by_text = F.col("fts_rank").isNotNull() & (F.col("vec_rank").isNull() | (F.col("fts_rank") <= F.col("vec_rank")))
    raw = F.when(by_text, text.match_snippet("extracted_text", text.query_tokens(query))).when(F.col("chunk_text").isNotNull(), text.first_sentences("chunk_text")).otherwise(F.substring("extracted_text", 1, 200))
    return best.join(F.broadcast(rows), "best_chunk", "right").withColumn("snippet", text.format_snippet(raw))


RESULT = (("id", "fileId"), ("root_id", "rootId"), ("path", "path"), ("filename", "filename"), ("media_type", "mediaType"), ("size_bytes", "sizeBytes"), ("indexed_at", "indexedAt"), ("confidence", "confidence"), ("snippet", "snippet"), ("score", "score"))


def project(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(a).alias(b) for a, b in RESULT))


def search(t: Tables, q: SearchQuery, vector: list[float] | None = None, prefilter: bool = False) -> DataFrame:
    """The page of results; snippets are made for its rows only."""
    return project(snippets(page(candidates(t, q, vector, prefilter), q), t.chunks, q.query_text)).orderBy(F.desc("score"), "path")


def recent_files(t: Tables, limit: int = 4) -> DataFrame:
    live = with_roots(t).where(F.col("deleted_at").isNull() & F.col("active")).orderBy(F.desc("indexed_at"), F.desc("id")).limit(min(8, max(1, limit)))
    return project(live.withColumns({"path": F.concat_ws("/", F.regexp_replace("root_path", "/+$", ""), "rel_path"), "snippet": text.format_snippet(F.substring("extracted_text", 1, 200)), "score": F.lit(0.0)}))
