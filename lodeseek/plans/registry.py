"""The registered queries over the driver's tables. The SQL of each is in ``oracles``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.filters import apply_filters, parse_query
from ..operators import chunking, embedding, fulltext, fusion, incremental, rerank, vector
from ..sources import git, scan
from . import oracles
from .search import Searcher
from .store import Store
from .tables import TableEmbedder, TableStore, chunks_of, files_of, read, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL = oracles.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return files_of(read(spark, sf, "documents"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_of(spread(read(spark, sf, "documents")))


# sources


@query
def scan_language(spark, sf):
    p = F.col("path")
    return _files(spark, sf).select("id", tx.extension(p).alias("ext"), tx.basename(p).alias("base"), tx.language(p).alias("language"))


@query
def scan_accept(spark, sf):
    names = F.array(*[F.lit(x) for x in oracles.NAMES])
    p = F.concat(F.lit("a.b/"), F.get(names, (F.col("doc_id") % len(oracles.NAMES)).cast("int")))
    rows = read(spark, sf, "documents").select("doc_id", p.alias("path"))
    p = F.col("path")
    return rows.select("doc_id", tx.is_binary_name(p).alias("is_binary"), tx.is_source_name(p).alias("is_source"), scan.hidden(p).alias("is_hidden"), scan.excluded(p, oracles.GLOBS).alias("is_excluded"))


@query
def scan_size_and_content(spark, sf):
    """Pages of up to the scanner's size of files that hold no NUL."""
    pages = read(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    size = F.octet_length("content")
    kept = pages.where(size.between(1, scan.MAX_FILE_SIZE)).where(~tx.has_nul(F.col("content")))
    return kept.select("page_id", size.cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query
def scan_total_size(spark, sf):
    return scan.total_size(read(spark, sf, "pages").select(F.octet_length("html").cast("long").alias("size")))


@query
def scan_dedupe_hash(spark, sf):
    return _files(spark, sf).groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query
def repository_names(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.repository_id(F.col("url")).alias("repo"))


@query
def git_status_lines(spark, sf):
    kind = F.element_at(F.create_map(*[F.lit(x) for p in oracles.STATUS_LINES.items() for x in p]), F.col("event_type"))
    lines = read(spark, sf, "events").select("event_id", F.concat(kind, F.lit("\tsrc/f"), F.col("user_id").cast("string"), F.when(kind.startswith("R"), F.concat(F.lit("\tlib/f"), F.col("user_id").cast("string"))).otherwise("")).alias("line"))
    return lines.select("event_id", git.parsed_status(F.col("line")).alias("c")).select("event_id", "c.*")


@query
def change_feed_routing(spark, sf):
    kind = F.element_at(F.create_map(*[F.lit(x) for p in oracles.STATUSES.items() for x in p]), F.col("event_type"))
    changes = read(spark, sf, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), kind.alias("status"), F.when(kind == "renamed", F.concat(F.lit("old"), F.col("user_id").cast("string"))).alias("old_path"))
    return incremental.routed(changes).groupBy("path", "action").agg(F.count("*").alias("n"))


# scalar functions and filters


@query
def token_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query
def embed_text_format(spark, sf):
    c, f = _chunks(spark, sf), _files(spark, sf).select(F.col("id").alias("file_id"), "path", "language")
    name = F.when(F.col("file_id") % 3 == 0, F.lit(None)).when(F.col("file_id") % 3 == 1, F.lit("")).otherwise(F.col("name"))
    both = c.join(f, "file_id")
    return both.select("id", tx.embedding_text(F.col("path"), F.col("language"), F.col("chunk_type"), name, F.col("content")).alias("text"))


@query
def rerank_documents(spark, sf):
    both = _chunks(spark, sf).join(_files(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id")
    name = F.when(F.col("id") % 2 == 0, F.col("name"))
    kind = F.when(F.col("id") % 3 > 0, F.col("chunk_type"))
    return both.select("id", F.md5(tx.rerank_document(kind, name, F.col("path"), F.col("content"))).alias("digest"))


@query
def previews(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.preview(F.col("text"), 2).alias("preview"), tx.truncated(F.col("text"), 60).alias("short"))


def _filtered(spark, sf, text):
    rows = _files(spark, sf).select("id", F.col("path").alias("file_path"))
    return apply_filters(rows, parse_query(text)[1])


@query
def filter_path_include(spark, sf):
    return _filtered(spark, sf, "word path:src1 path:src2/en/")


@query
def filter_cross_type(spark, sf):
    return _filtered(spark, sf, "path:src1 path:src2 ext:ts ext:.py -file:doc_12.ts")


@query
def filter_exclude(spark, sf):
    return _filtered(spark, sf, "-path:src0 -ext:md file:doc_7.ts file:en/doc_8.ts file:doc_9.go -file:doc_11.ts")


# full text


@query
def tokenize_df(spark, sf):
    return fulltext.document_frequencies(_chunks(spark, sf))


@query
def accent_folding(spark, sf):
    """Tokens of texts whose letters have got marks, composed and decomposed."""
    marked = F.regexp_replace(F.translate(F.col("text"), "aczo", "ăčżő"), "n", "n\u0301")
    return read(spark, sf, "documents").select("doc_id", F.md5(F.array_join(tx.tokens(marked), " ")).alias("digest"))


@query
def corpus_stats(spark, sf):
    return fulltext.lengths(_chunks(spark, sf)).agg(F.count("*").alias("n"), F.sum("len").alias("words"), F.round(F.avg("len"), 6).alias("avgdl"))


@query
def postings_positions(spark, sf):
    rows = fulltext.postings(_chunks(spark, sf))
    return rows.select("term", "chunk_id", "col", F.size("positions").alias("f"), F.get("positions", F.lit(0)).alias("first"), F.element_at("positions", -1).alias("last"))


def _bm25(spark, sf, text, limit=30):
    s = TableStore(spark, sf)
    return s.search_bm25(text, limit).select("chunk_id", "file_path", F.round("rank", 8).alias("rank"))


for _name, (_text, _, _) in oracles.BM25.items():
    QUERIES[_name] = lambda spark, sf, text=_text: _bm25(spark, sf, text)


@query
def bm25_normalized(spark, sf):
    s = TableStore(spark, sf)
    return s.search_bm25("thble", 40).select("chunk_id", F.round("score", 8).alias("score"))


@query
def bm25_batch_queries(spark, sf):
    """All words of each benchmark item as its query."""
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    c = _chunks(spark, sf)
    out = fulltext.bm25_batch(fulltext.postings(c), fulltext.lengths(c), asked, 10)
    return out.select("query_id", "chunk_id", F.round("rank", 8).alias("rank"))


# vectors


def _query_vectors(spark, sf, n):
    return [(r["vec_id"], list(r["embedding"])) for r in read(spark, sf, "embeddings").orderBy("vec_id").limit(n).collect()]


@query
def knn_topk(spark, sf):
    s = TableStore(spark, sf)
    return vector.search_vectors(s.table("vectors"), _query_vectors(spark, sf, 1)[0][1], 20).select("chunk_id", F.round("distance", 6).alias("distance"), F.round(vector.distance_score(F.col("distance")), 6).alias("score"))


@query
def knn_batch(spark, sf):
    """The ten nearest, among all vectors, of every vector whose id is divisible by 50."""
    rows = TableStore(spark, sf).table("vectors")
    asked = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    out = vector.search_table(rows, asked, 10, _scratch(spark, "knn"))
    return out.select("query_id", "chunk_id", "place", F.round("distance", 6).alias("distance"))


@query
def knn_active_after_k(spark, sf):
    s = TableStore(spark, sf)
    return s.search_vector(_query_vectors(spark, sf, 1)[0][1], 30).select("chunk_id", "file_path", F.round("distance", 6).alias("distance"))


# fusion, pipeline


def _results(response, n=8):
    return response.results.select("chunk_id", "file_path", F.round("score", n).alias("score"), F.round("scores.bm25", n).alias("bm25"), F.round("scores.vector", 6).alias("vector"))


def _searcher(spark, sf):
    s = TableStore(spark, sf)
    return Searcher(s, TableEmbedder(s))


@query
def rrf_bm25_only(spark, sf):
    return _results(_searcher(spark, sf).search("thble", "bm25", 15))


@query
def rrf_vector_only(spark, sf):
    return _results(_searcher(spark, sf).search("#0", "vector", 15))


@query
def search_filtered(spark, sf):
    return _results(_searcher(spark, sf).search("thble path:src1 path:src2 path:src3 path:src0 -file:doc_1.ts", "bm25", 10))


@query
def rrf_hybrid(spark, sf):
    s = TableStore(spark, sf)
    a = fusion.ranked_list(s.search_bm25("thble", 45), "bm25", 0, "rank", "chunk_id")
    b = fusion.ranked_list(s.search_vector(_query_vectors(spark, sf, 1)[0][1], 45), "vector", 0, "distance", "chunk_id")
    return fusion.fuse(fusion.union_lists([a, b]), 15).select("chunk_id", F.round("rrf", 8).alias("rrf"), F.round("bm25", 8).alias("bm25"), F.round("vector", 6).alias("vector"))


@query
def rrf_multi_list_weights(spark, sf):
    """Fusions of all conversations' turns: a list is a conversation's role, ranked by length of text."""
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"), tx.token_estimate(F.col("text")).alias("t"))
    lists = []
    for i, (source, index, key) in enumerate(oracles.LISTS):
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n") if key == "long" else F.col("turn"), "turn")) - 1
        of = rows.where(F.col("turn") % 3 != i)
        lists.append(of.select("conv_id", F.lit(source).alias("source"), F.lit(index).alias("list_idx"), place.alias("rank0"), F.col("turn").alias("chunk_id"), F.col("t").cast("double").alias("score")))
    out = fusion.fuse(fusion.union_lists(lists), by=("conv_id",))
    return out.select("conv_id", F.col("chunk_id").alias("turn"), F.round("rrf", 8).alias("rrf"), "bm25", "vector", F.col("first_seen.list_idx").alias("seen_list"), F.col("first_seen.rank0").cast("int").alias("seen_rank"))


@query
def hybrid_filtered(spark, sf):
    s = TableStore(spark, sf)
    a = fusion.ranked_list(s.search_bm25("thble", 150), "bm25", 0, "rank", "chunk_id")
    b = fusion.ranked_list(s.search_vector(_query_vectors(spark, sf, 1)[0][1], 150), "vector", 0, "distance", "chunk_id")
    fused = fulltext.with_chunks(F.broadcast(fusion.fuse(fusion.union_lists([a, b]), 150)), s.table("chunks"), s.table("files"), active=False)
    kept = apply_filters(fused, parse_query("ext:ts -path:src0")[1])
    return kept.orderBy(F.desc("rrf"), "first_seen").limit(15).select("chunk_id", "file_path", F.round("rrf", 8).alias("rrf"))


# reranking and model replies


def _turns(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "turn")) - 1
    return rows.select("conv_id", "turn", place.alias("place"), (1.0 / (61 + place)).alias("score"), ((F.col("n") % 17) / F.lit(8.0)).alias("raw"))


@query
def rerank_normalize(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(rerank.normalised(F.col("raw"), ["conv_id"]), 8).alias("rerank"))


@query
def rerank_blend(spark, sf):
    rows = _turns(spark, sf).withColumn("rerank", rerank.normalised(F.col("raw"), ["conv_id"]))
    out = rerank.blended(rows, 4, ["conv_id"])
    return out.select("conv_id", "turn", F.col("position").cast("int").alias("position"), F.round("score", 8).alias("score"), F.round("rerank", 8).alias("rerank"))


@query
def llm_score_parse(spark, sf):
    reply = F.concat_ws(",", F.col("value").cast("string"), (F.col("user_id") / 100).cast("string"), "event_type", F.lit(" 0.25x"), F.lit("-1"))
    n = (1 + F.col("event_id") % 7).cast("int")
    return read(spark, sf, "events").select("event_id", F.array_join(F.transform(rerank.parsed_scores(reply, n), lambda x: F.format_string("%.4f", x)), " ").alias("scores"))


@query
def expansion_parse(spark, sf):
    kind = F.when(F.col("turn") % 4 == 0, "lex").when(F.col("turn") % 4 == 1, "vec").when(F.col("turn") % 4 == 2, "hyde").otherwise("other")
    text = F.concat(F.lit(" "), F.col("role"), F.lit(" "), F.col("turn").cast("string"))
    item = F.to_json(F.struct(kind.alias("type"), text.alias("text")))
    reply = F.concat(F.lit("Here it is:\n["), item, F.lit(',{"type":"lex","text":"  "},{"type":"vec","text":"user 0"}]\nDone'))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.explode(rerank.parsed_expansion(reply, F.lit(" user 0 "))).alias("v"))
    return rows.select("conv_id", "turn", "v.type", "v.text")


# incremental maintenance


def _two_versions(spark, sf):
    """Stored files, and a scan in which some texts are new, some files gone and some added."""
    d = read(spark, sf, "documents")
    stored = files_of(d).where("id % 7 <> 3")
    seen = files_of(d).where("id % 11 <> 5").select("repo_id", "path", F.when(F.col("id") % 5 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")).alias("hash"), "language", F.col("id").alias("doc"))
    return stored, seen


@query
def file_upsert_changed(spark, sf):
    stored, seen = _two_versions(spark, sf)
    return incremental.file_changes(stored, seen).select("path", "status")


@query
def file_upsert_rows(spark, sf):
    stored, seen = _two_versions(spark, sf)
    files, _ = incremental.upsert_files(stored, seen.drop("doc"), 1_000_000_000)
    return files.select("path", "hash", "active", (F.col("id") > 1_000_000_000).alias("is_new"))


@query
def deleted_files_anti(spark, sf):
    stored, seen = _two_versions(spark, sf)
    return incremental.missing_files(stored, seen).select("id", "path")


def _chunk_versions(spark, sf):
    """Chunks are lines of documents; in the new version every fifth line is another and every eleventh is gone."""
    d = read(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "content"))
    old = lines.select((F.col("file_id") * 100_000 + F.col("seq")).alias("id"), "file_id", "seq", tx.content_hash(F.col("content")).alias("hash"))
    new = lines.where("seq % 11 <> 7").select("file_id", "seq", tx.content_hash(F.when(F.col("seq") % 5 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("hash"))
    return old, new


@query
def chunk_diff_reuse(spark, sf):
    reused, _, _ = incremental.chunk_diff(*_chunk_versions(spark, sf))
    return reused.select("id", "new_seq")


@query
def chunk_diff_deleted(spark, sf):
    _, deleted, _ = incremental.chunk_diff(*_chunk_versions(spark, sf))
    return deleted


@query
def chunk_diff_inserted(spark, sf):
    _, _, inserted = incremental.chunk_diff(*_chunk_versions(spark, sf))
    return inserted.select("file_id", "seq", "hash")


@query
def unembedded_chunks(spark, sf):
    s = TableStore(spark, sf)
    return incremental.unembedded(s.table("chunks"), s.table("files"), s.table("vectors")).select("id", "file_path", "language")


@query
def cleanup_orphans(spark, sf):
    s = TableStore(spark, sf)
    return incremental.orphan_chunks(s.table("chunks"), s.table("files")).select("id")


@query
def orphan_vectors(spark, sf):
    s = TableStore(spark, sf)
    left = s.table("chunks").join(incremental.orphan_chunks(s.table("chunks"), s.table("files")).select("id"), "id", "left_anti")
    return incremental.orphan_vectors(s.table("vectors"), left).select("chunk_id")


@query
def deactivate_files(spark, sf):
    files = _files(spark, sf)
    return incremental.deactivate(files, files.where(F.col("path").startswith("src1/")).select("id")).select("id", "active")


@query
def stats(spark, sf):
    s = TableStore(spark, sf)
    return incremental.statistics(*(s.table(t) for t in ("repositories", "files", "chunks", "vectors")))


@query
def get_file_chunks(spark, sf):
    """Turns of all conversations as chunks of their files, in order."""
    rows = read(spark, sf, "conversations")
    return rows.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("path"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"), "turn", F.md5("text").alias("digest"))


@query
def get_chunk(spark, sf):
    c = _chunks(spark, sf).join(_files(spark, sf).select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "active"), "file_id")
    return c.select("id", "file_path", "active", "seq", "end_line")


# a store on disk


def _scratch(spark, name):
    """A new folder in the shared folder of the cluster; on this machine only if it is all there is."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='lodeseek-')}/{name}-{uuid.uuid4().hex}"


def _turn_chunks(rows):
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("turn")) - 1
    c = rows.select("file_id", "turn", "text", "role").withColumn("seq", place.cast("int"))
    return incremental.with_hash(c.select("file_id", "seq", (F.col("seq") + 1).alias("start_line"), (F.col("seq") + 1).alias("end_line"), F.lit("block").alias("chunk_type"), F.col("role").alias("name"), F.col("text").alias("content")))


def _conversation_store(spark, sf):
    """A store of all conversations, their turns as chunks, with vectors; then every third has changed and every seventh is gone."""
    s = Store(spark, _scratch(spark, "store"), buckets=8)
    s.upsert_repository("main", "/talks")
    s.upsert_repository("main", "/conversations", "c0ffee")
    turns = read(spark, sf, "conversations").withColumn("path", F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".md")))
    scanned = turns.select(F.lit("main").alias("repo_id"), "path", F.sha2(F.col("conv_id").cast("string"), 256).alias("hash"), F.lit("markdown").alias("language")).distinct()
    s.upsert_files(scanned)
    turns = turns.join(s.table("files").select(F.col("id").alias("file_id"), "path"), "path")
    s.replace_chunks(s.table("files").select(F.col("id").alias("file_id")), _turn_chunks(turns))
    vector = F.array(F.length("content"), F.col("seq") + 1).cast("array<float>")
    s.insert_embeddings(s.table("chunks").select(F.col("id").alias("chunk_id"), vector.alias("embedding"), F.lit("sizes").alias("model"), F.lit(None).cast("timestamp").alias("embedded_at")))
    high = s.state["chunk_id"]
    later = turns.where("conv_id % 3 = 0 AND turn % 5 <> 4").withColumn("text", F.when(F.col("turn") % 4 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    s.replace_chunks(turns.where("conv_id % 3 = 0").select("file_id").distinct(), _turn_chunks(later))
    s.deactivate_files(turns.where("conv_id % 7 = 0").select(F.col("file_id").alias("id")).distinct())
    return s, high


def _with_path(store, rows):
    return rows.join(store.table("files").select(F.col("id").alias("file_id"), "path"), "file_id")


@query
def store_repository(spark, sf):
    s, _ = _conversation_store(spark, sf)
    return s.repository("main").unionByName(s.repository_by_path("/conversations")).select("id", "path", "last_commit")


@query
def store_files(spark, sf):
    return _conversation_store(spark, sf)[0].active_files("main").select("path", "hash", "language", "active")


@query
def store_file_lookup(spark, sf):
    s, _ = _conversation_store(spark, sf)
    return s.file("main", "conv_1.md").select("path", "hash", "active")


@query
def store_chunks(spark, sf):
    s, high = _conversation_store(spark, sf)
    return _with_path(s, s.table("chunks")).select("path", "seq", "name", F.md5("content").alias("digest"), (F.col("id") <= high).alias("reused"))


@query
def store_file_chunks(spark, sf):
    """Chunks of one file, in order, with their file."""
    s, _ = _conversation_store(spark, sf)
    file_id = s.file("main", "conv_3.md").first()["id"]
    return s.file_chunks(file_id).select("seq", "start_line", "end_line", "name", F.md5("content").alias("digest"))


@query
def store_chunk(spark, sf):
    s, _ = _conversation_store(spark, sf)
    file_id = s.file("main", "conv_3.md").first()["id"]
    first = s.file_chunks(file_id).where("seq = 0").first()["id"]
    return s.chunk(first).select("file_path", "repo_id", "language", "seq", F.md5("content").alias("digest"))


@query
def store_vectors(spark, sf):
    s, _ = _conversation_store(spark, sf)
    held = s.table("vectors").join(s.table("chunks").select(F.col("id").alias("chunk_id"), "file_id", "seq"), "chunk_id")
    return _with_path(s, held).select("path", "seq", F.get("embedding", F.lit(0)).cast("long").alias("size"), "model")


@query
def store_unembedded(spark, sf):
    return _conversation_store(spark, sf)[0].unembedded().select("file_path", F.md5("content").alias("digest"))


@query
def store_stats(spark, sf):
    return _conversation_store(spark, sf)[0].stats()


@query
def store_search(spark, sf):
    """All hits of a word in the store."""
    s, _ = _conversation_store(spark, sf)
    hits = s.search_bm25("thble", None)
    return hits.select("file_path", F.md5("content").alias("digest"), F.round("rank", 8).alias("rank")).distinct()


@query
def store_search_prefix_near(spark, sf):
    """All hits of a prefix next to a word, in the store."""
    s, _ = _conversation_store(spark, sf)
    hits = s.search_bm25('NEAR("the" "th" * , 1)', None)
    return hits.select("file_path", F.md5("content").alias("digest")).distinct()


@query
def store_cleanup(spark, sf):
    s, _ = _conversation_store(spark, sf)
    chunks, vectors = s.cleanup()
    left = s.stats()
    return left.select(F.lit(chunks).alias("deleted_chunks"), F.lit(vectors).alias("deleted_vectors"), "files", "chunks", "embedded", "pending")


@query
def store_clear(spark, sf):
    s, _ = _conversation_store(spark, sf)
    s.clear_vectors()
    first = s.stats()
    rows = first.select(F.lit("vectors").alias("cleared"), "repositories", "files", "chunks", "embedded").collect()
    s.clear_all()
    return spark.createDataFrame(rows, "cleared string, repositories long, files long, chunks long, embedded long").unionByName(s.stats().select(F.lit("all").alias("cleared"), "repositories", "files", "chunks", "embedded"))


@query
def scan_directory(spark, sf):
    """A scan of a folder of files named for nations, of which some are hidden, empty, binary, excluded or of no language."""
    root = _scratch(spark, "scan")
    jvm = spark.sparkContext._jvm
    for r in read(spark, sf, "nation").collect():  # 25 rows
        name, text = oracles.scan_file(r["n_nationkey"], r["n_name"])
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    found = scan.scan(spark, root, "main", ["skip/**"])
    return found.select("path", "language", "hash")


# chunking and embedding


@query
def syntax_languages(spark, sf):
    """Declarations of a small file in each language of a parser, for all documents."""
    n = len(oracles.SOURCES)
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), (F.col("doc_id") % n).cast("int").alias("k"))
    ext, code = (F.get(F.array(*[F.lit(x) for x in col]), F.col("k")) for col in zip(*[(e, c) for e, c, _ in oracles.SOURCES], strict=True))
    rows = rows.select("file_id", F.concat(F.lit("f"), F.col("file_id").cast("string"), ext).alias("path"), F.replace(code, F.lit("@"), F.col("file_id").cast("string")).alias("content"))
    return chunking.chunk_files(rows).select("file_id", "seq", "chunk_type", "name", "start_line", "end_line")


@query
def long_line_split(spark, sf):
    out = chunking.fixed_slices(read(spark, sf, "documents"), "doc_id", "text", 3600)
    return out.select("doc_id", "part", F.md5("content").alias("digest"), F.length("content").alias("n"))


@query
def token_chunks(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.lit("a.txt").alias("path"), F.col("text").alias("content"))
    return chunking.chunk_files(d)


@query
def syntax_chunks(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), path_as_code().alias("path"), F.concat(F.lit("import os\n\ndef f():\n    return 1\n\nclass C:\n    x = 2\n\nTEXT = '''\n"), F.col("text"), F.lit("\n'''\n")).alias("content"))
    return chunking.chunk_files(d)


def path_as_code():
    return F.concat(F.lit("p/f"), F.col("doc_id").cast("string"), F.lit(".py"))


@query
def embed_batches(spark, sf):
    """Hashed vectors of all chunks, by their formatted texts."""
    s = TableStore(spark, sf)
    todo = incremental.unembedded(s.table("chunks"), s.table("files"), s.table("vectors").limit(0))
    return embedding.embed_chunks(todo, lambda: embedding.HashEmbedder(16)).select("chunk_id", "embedding", "model")
