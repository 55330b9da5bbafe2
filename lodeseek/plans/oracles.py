"""SQL of the registered queries, for DuckDB over the same tables; written from the definitions, not from the plans."""

from __future__ import annotations

from ..functions.text import BINARY_EXTENSIONS, EXTENSION_LANGUAGES, FILENAME_LANGUAGES

#: File names and globs that the scan queries try.
NAMES = ["a.ts", "b.PNG", "Dockerfile.dev", "Makefile", "c.xyz", "noext", ".bashrc", "x.min.js", "d.tar.gz", "e.LOCK", "CMakeLists.txt", "f.kt"]
GLOBS = ["node_modules/**", "**/*.min.js", "a.b/{c,d}.*", "*.lock"]
STATUS_LINES = {"view": "M", "signup": "A", "purchase": "R087", "error": "D", "click": "T"}
STATUSES = {"view": "modified", "signup": "added", "purchase": "renamed", "error": "deleted", "click": "modified"}
#: Lists of the fusion query: source, place among its source's lists, order.
LISTS = [("bm25", 0, "long"), ("bm25", 1, "turn"), ("vector", 0, "turn")]


#: For each language: extension, a file in which @ is a number, and its declarations as (type, name, first and last line).
SOURCES = [
    (".ts", "export interface I@ {\n  x: number;\n}\n\nexport class C@ {\n  m(): string {\n    return '}';\n  }\n}\n\nexport function f@(a: number) {\n  return a;\n}\n", [("interface", "I@", 1, 3), ("class", "C@", 5, 9), ("function", "f@", 11, 13)]),
    (".js", "class C@ {\n  m() { return 1 }\n}\n\nfunction f@(a) {\n  return a;\n}\n", [("class", "C@", 1, 3), ("function", "f@", 5, 7)]),
    (".py", "def f@():\n    return 1\n\n\nclass C@:\n    def m(self):\n        pass\n", [("function", "f@", 1, 2), ("class", "C@", 5, 7)]),
    (".go", "func F@(a int) int {\n\treturn a\n}\n\ntype T@ struct {\n\ta int\n}\n", [("function", "F@", 1, 3), ("type", "T@", 5, 7)]),
    (".kt", "class K@(val x: Int) {\n  fun m() = 1\n}\n\nfun top@(): Int {\n  return 2\n}\n", [("class", "K@", 1, 3), ("function", "top@", 5, 7)]),
    (".swift", "struct S@ {\n  let a: Int\n}\n\nprotocol P@ {\n}\n\nfunc go@() -> Int {\n  return 1\n}\n", [("struct", "S@", 1, 3), ("protocol", "P@", 5, 6), ("function", "go@", 8, 10)]),
    (".dart", "class D@ {\n  int x = 1;\n}\n\nint add@(int a, int b) {\n  return a + b;\n}\n", [("class", "D@", 1, 3), ("function", "add@", 5, 7)]),
]
#: Names of the scanned files, by the key's remainder.
SCANNED = ["src/{}.ts", "{}.py", "docs/deep/{}.md", ".hidden/{}.ts", "skip/{}.go", "{}.png", "empty_{}.rs", "nul_{}.c", "{}.xyz"]


def scan_file(key: int, name: str) -> tuple[str, str]:
    """Name and text of a file of the scan query."""
    n = name.replace(" ", "_").lower()
    kind = key % len(SCANNED)
    return SCANNED[kind].format(n), "" if kind == 6 else f"{name}\x00\n" if kind == 7 else f"{name} é\n"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


FILES = """files AS (
  SELECT doc_id AS id, 'main' AS repo_id, source || '/' || lang || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'ts' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'go' ELSE 'md' END AS path,
    sha256(text) AS hash, CASE lang WHEN 'en' THEN 'typescript' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'go' ELSE 'markdown' END AS language, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS active
  FROM documents)"""
WORDS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
TOKENS = f"""tok AS (
  SELECT doc_id AS chunk_id, 'content' AS col, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents)
  UNION ALL SELECT doc_id, 'name', unnest(w), generate_subscripts(w, 1) - 1 FROM (SELECT doc_id, {WORDS.format("source")} AS w FROM documents)),
dl AS (SELECT doc_id AS chunk_id, coalesce(n, 0) AS len FROM documents LEFT JOIN (SELECT chunk_id AS doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)),
st AS (SELECT count(*) AS n, CAST(sum(len) AS DOUBLE) / count(*) AS avgdl FROM dl)"""


def bm25_sql(phrases: list[list[str]], condition: str, columns: list[str] | None = None) -> str:
    """CTEs up to ``ranked`` (chunk_id, rank) of the chunks where the condition over f0, f1, … holds."""
    ctes = [TOKENS]
    for i, words in enumerate(phrases):
        joins = "".join(f" JOIN tok t{k} ON t{k}.chunk_id = t0.chunk_id AND t{k}.col = t0.col AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{w}'" for k, w in enumerate(words) if k)
        only = f" AND t0.col = '{columns[i]}'" if columns and columns[i] else ""
        ctes.append(f"p{i} AS (SELECT t0.chunk_id, count(*) AS f FROM tok t0{joins} WHERE t0.term = '{words[0]}'{only} GROUP BY 1)")
    fs = ", ".join(f"coalesce(p{i}.f, 0) AS f{i}, (SELECT count(*) FROM p{i}) AS n{i}" for i in range(len(phrases)))
    ctes.append(f"m AS (SELECT chunk_id, len, {fs} FROM dl " + " ".join(f"LEFT JOIN p{i} USING (chunk_id)" for i in range(len(phrases))) + ")")
    idf = "CASE WHEN ln((st.n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((st.n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    part = "(" + idf + ") * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / st.avgdl))"
    total = " + ".join(part.format(i=i) for i in range(len(phrases)))
    ctes.append(f"ranked AS (SELECT chunk_id, -({total}) AS rank FROM m, st WHERE {condition})")
    return ",\n".join(ctes)


#: name: query text, phrases, condition
BM25 = {
    "bm25_single": ("thble", [["thble"]], "f0 > 0"),
    "bm25_and": ("Thble  anea ++", [["thble"], ["anea"]], "f0 > 0 AND f1 > 0"),
    "bm25_phrase": ("of.the thble", [["of", "the"], ["thble"]], "f0 > 0 AND f1 > 0"),
    "bm25_or_raw": ('thble OR "anea" OR "of the"', [["thble"], ["anea"], ["of", "the"]], "f0 > 0 OR f1 > 0 OR f2 > 0"),
    "bm25_not_raw": ("thble NOT (anea OR thor)", [["thble"], ["anea"], ["thor"]], "f0 > 0 AND NOT (f1 > 0 OR f2 > 0)"),
    "bm25_column_raw": ("{name} : src1 AND content : thble", [["src1"], ["thble"]], "f0 > 0 AND f1 > 0"),
    "bm25_repeated_word": ("thble thble", [["thble"], ["thble"]], "f0 > 0 AND f1 > 0"),
}
_COLUMNS = {"bm25_column_raw": ["name", "content"]}
_TOP = "SELECT chunk_id, path AS file_path, round(rank, 8) AS rank FROM (SELECT chunk_id, path, ranked.rank FROM ranked JOIN files ON files.id = chunk_id AND active = 1 ORDER BY ranked.rank, chunk_id LIMIT {n})"
SQL: dict[str, str] = {k: f"WITH {FILES},\n{bm25_sql(p, c, _COLUMNS.get(k))}\n{_TOP.format(n=30)}" for k, (_, p, c) in BM25.items()}

_THBLE = bm25_sql([["thble"]], "f0 > 0")


def _hits(n: int) -> str:
    return f"bm AS (SELECT chunk_id, path, rank, abs(rank) / (1 + abs(rank)) AS score, row_number() OVER (ORDER BY rank, chunk_id) - 1 AS rank0 FROM ranked JOIN files ON files.id = chunk_id AND active = 1 ORDER BY rank, chunk_id LIMIT {n})"


def _near(n: int) -> str:
    return f"""v AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT e AS qe FROM v ORDER BY chunk_id LIMIT 1),
knn AS (SELECT chunk_id, 1 - list_cosine_similarity(e, qe) AS distance FROM v, q ORDER BY distance, chunk_id LIMIT {n}),
vh AS (SELECT chunk_id, path, distance, greatest(0, 1 - distance) AS score, row_number() OVER (ORDER BY distance, chunk_id) - 1 AS rank0 FROM knn JOIN files ON files.id = chunk_id AND active = 1)"""



_FUSE = "fused AS (SELECT chunk_id, sum(w) AS rrf, max(bm25) AS bm25, max(vector) AS vector, min((s, rank0)) AS seen FROM (SELECT chunk_id, 2.0 / (61 + rank0) AS w, score AS bm25, NULL AS vector, 0 AS s, rank0 FROM bm UNION ALL SELECT chunk_id, 2.0 / (61 + rank0), NULL, score, 1, rank0 FROM vh) GROUP BY 1)"
_SRC = "(path LIKE 'src0/%' OR path LIKE 'src1/%' OR path LIKE 'src2/%' OR path LIKE 'src3/%')"

SQL |= {
    "scan_language": f"WITH {FILES} SELECT id, '.' || split_part(path, '.', 2) AS ext, split_part(path, '/', 3) AS base, language FROM files",
    "scan_accept": f"""WITH n AS (SELECT doc_id, ({NAMES!r})[CAST(doc_id % {len(NAMES)} AS INTEGER) + 1] AS name FROM documents),
e AS (SELECT doc_id, name, CASE WHEN regexp_matches(name, '^.+\\.') THEN lower('.' || list_last(string_split(name, '.'))) ELSE '' END AS ext FROM n)
SELECT doc_id, ext IN {_in(BINARY_EXTENSIONS)} AS is_binary, (ext IN {_in(EXTENSION_LANGUAGES)} OR name IN {_in(FILENAME_LANGUAGES)} OR starts_with(name, 'Dockerfile.') OR ext = '') AS is_source,
  starts_with(name, '.') AS is_hidden, (ends_with(name, '.min.js') OR starts_with(name, 'c.') OR starts_with(name, 'd.')) AS is_excluded FROM e""",
    "scan_size_and_content": "SELECT page_id, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS hash FROM pages WHERE strlen(html) BETWEEN 1 AND 1048576 AND NOT contains(html, chr(0))",
    "scan_total_size": "SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS total_size FROM pages",
    "scan_dedupe_hash": f"WITH {FILES} SELECT hash, count(*) AS n, min(id) AS first_id FROM files GROUP BY 1 HAVING count(*) > 1",
    "repository_names": "SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS repo FROM pages",
    "git_status_lines": f"WITH e AS (SELECT event_id, user_id, {_case('event_type', STATUS_LINES)} AS k FROM events) SELECT event_id, CASE left(k, 1) WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS status, CASE WHEN k = 'R087' THEN 'lib/f' ELSE 'src/f' END || user_id AS path, CASE WHEN k = 'R087' THEN 'src/f' || user_id END AS old_path FROM e",
    "change_feed_routing": f"""WITH e AS (SELECT 'f' || user_id AS path, {_case('event_type', STATUSES)} AS status, 'old' || user_id AS old_path FROM events)
SELECT path, action, count(*) AS n FROM (SELECT path, CASE WHEN status = 'deleted' THEN 'deactivate' ELSE 'process' END AS action FROM e UNION ALL SELECT old_path, 'deactivate' FROM e WHERE status = 'renamed') GROUP BY 1, 2""",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    "embed_text_format": f"WITH {FILES} SELECT doc_id AS id, 'file: ' || path || ' | language: ' || language || ' | type: block' || CASE WHEN doc_id % 3 = 2 THEN ' | name: ' || source ELSE '' END || ' | code: ' || text AS text FROM documents JOIN files ON id = doc_id",
    "rerank_documents": f"WITH {FILES} SELECT doc_id AS id, md5('[' || CASE WHEN doc_id % 3 > 0 THEN 'block' ELSE 'chunk' END || '] ' || CASE WHEN doc_id % 2 = 0 THEN source || ' (' || path || ')' ELSE path END || chr(10) || text) AS digest FROM documents JOIN files ON id = doc_id",
    "previews": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) AS preview, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 57) || '...' END AS short FROM documents",
    "filter_path_include": f"WITH {FILES} SELECT id, path AS file_path FROM files WHERE path LIKE 'src1/%' OR path LIKE 'src2/en/%'",
    "filter_cross_type": f"WITH {FILES} SELECT id, path AS file_path FROM files WHERE (path LIKE 'src1/%' OR path LIKE 'src2/%') AND (path LIKE '%.ts' OR path LIKE '%.py') AND split_part(path, '/', 3) <> 'doc_12.ts'",
    "filter_exclude": f"WITH {FILES} SELECT id, path AS file_path FROM files WHERE NOT (path LIKE 'src0/%' OR path LIKE '%.md' OR split_part(path, '/', 3) = 'doc_11.ts') AND (split_part(path, '/', 3) IN ('doc_7.ts', 'doc_9.go') OR ends_with(path, '/en/doc_8.ts'))",
    "tokenize_df": f"WITH {TOKENS} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM tok GROUP BY 1",
    "accent_folding": f"SELECT doc_id, md5(array_to_string({WORDS.format("text")}, ' ')) AS digest FROM documents",
    "corpus_stats": f"WITH {TOKENS} SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS words, round(CAST(sum(len) AS DOUBLE) / count(*), 6) AS avgdl FROM dl",
    "postings_positions": f"WITH {TOKENS} SELECT term, chunk_id, col, CAST(count(*) AS INTEGER) AS f, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM tok GROUP BY 1, 2, 3",
    "bm25_normalized": f"WITH {FILES},\n{_THBLE},\n{_hits(40)} SELECT chunk_id, round(score, 8) AS score FROM bm",
    "bm25_batch_queries": f"""WITH {TOKENS},
a AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({WORDS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
need AS (SELECT query_id, count(*) AS need FROM a GROUP BY 1),
tf AS (SELECT chunk_id, term, count(*) AS f FROM tok WHERE term IN (SELECT term FROM a) GROUP BY 1, 2), df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
s AS (SELECT query_id, chunk_id, count(*) AS got, -sum(times * CASE WHEN ln((st.n - df.n + 0.5) / (df.n + 0.5)) > 0 THEN ln((st.n - df.n + 0.5) / (df.n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / st.avgdl))) AS rank FROM a JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS k FROM s JOIN need USING (query_id) WHERE got = need)
SELECT query_id, chunk_id, round(rank, 8) AS rank FROM r WHERE k <= 10""",
    "knn_topk": f"WITH {FILES},\n{_near(20)} SELECT chunk_id, round(distance, 6) AS distance, round(greatest(0, 1 - distance), 6) AS score FROM knn",
    "knn_batch": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id AS chunk_id, 1 - list_cosine_similarity(e, qe) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(e, qe), vec_id) AS place FROM v, q)
SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place, round(distance, 6) AS distance FROM r WHERE place <= 10""",
    "knn_active_after_k": f"WITH {FILES},\n{_near(30)} SELECT chunk_id, path AS file_path, round(distance, 6) AS distance FROM vh",
    "rrf_bm25_only": f"WITH {FILES},\n{_THBLE},\n{_hits(45)} SELECT chunk_id, path AS file_path, round(2.0 / (61 + rank0), 8) AS score, round(score, 8) AS bm25, CAST(NULL AS DOUBLE) AS vector FROM bm WHERE rank0 < 15",
    "rrf_vector_only": f"WITH {FILES},\n{_near(45)} SELECT chunk_id, path AS file_path, round(2.0 / (61 + rank0), 8) AS score, CAST(NULL AS DOUBLE) AS bm25, round(score, 6) AS vector FROM vh WHERE rank0 < 15",
    "search_filtered": f"WITH {FILES},\n{_THBLE},\n{_hits(100)} SELECT chunk_id, path AS file_path, round(2.0 / (61 + rank0), 8) AS score, round(score, 8) AS bm25, CAST(NULL AS DOUBLE) AS vector FROM bm WHERE {_SRC} AND split_part(path, '/', 3) <> 'doc_1.ts' ORDER BY rank0 LIMIT 10",
    "rrf_hybrid": f"WITH {FILES},\n{_THBLE},\n{_hits(45)},\n{_near(45)},\n{_FUSE} SELECT chunk_id, round(rrf, 8) AS rrf, round(bm25, 8) AS bm25, round(vector, 6) AS vector FROM (SELECT * FROM fused ORDER BY rrf DESC, seen LIMIT 15)",
    "hybrid_filtered": f"WITH {FILES},\n{_THBLE},\n{_hits(150)},\n{_near(150)},\n{_FUSE}, top AS (SELECT * FROM fused ORDER BY rrf DESC, seen LIMIT 150) SELECT chunk_id, file_path, round(rrf, 8) AS rrf FROM (SELECT chunk_id, path AS file_path, rrf FROM top JOIN files ON id = chunk_id WHERE path LIKE '%.ts' AND path NOT LIKE 'src0/%' ORDER BY rrf DESC, seen LIMIT 15)",
    "rrf_multi_list_weights": "WITH r AS (SELECT conv_id, turn, length(text) AS n, CAST(ceil(length(text) / 4.0) AS DOUBLE) AS t FROM conversations), l AS (\n"
    + "\nUNION ALL ".join(f"SELECT conv_id, turn, {0 if s == 'bm25' else 1} AS s, {i} AS li, row_number() OVER (PARTITION BY conv_id ORDER BY {'n DESC, turn' if k == 'long' else 'turn'}) - 1 AS r0, {2.0 if i == 0 else 1.0} AS w, {'t' if s == 'bm25' else 'NULL'} AS bm25, {'t' if s == 'vector' else 'NULL'} AS vector FROM r WHERE turn % 3 <> {j}" for j, (s, i, k) in enumerate(LISTS))
    + ") SELECT conv_id, turn, round(sum(w / (61 + r0)), 8) AS rrf, max(bm25) AS bm25, max(vector) AS vector, CAST(arg_min(li, (s, li, r0)) AS INTEGER) AS seen_list, CAST(arg_min(r0, (s, li, r0)) AS INTEGER) AS seen_rank FROM l GROUP BY 1, 2",
}
_TURNS = "t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) - 1 AS place, (length(text) % 17) / 8.0 AS raw FROM conversations), s AS (SELECT *, 1.0 / (61 + place) AS score, greatest(0, raw / greatest(max(raw) OVER (PARTITION BY conv_id), 1)) AS rr, least(count(*) OVER (PARTITION BY conv_id), 4) AS n FROM t)"
SQL |= {
    "rerank_normalize": f"WITH {_TURNS} SELECT conv_id, turn, round(rr, 8) AS rerank FROM s",
    "rerank_blend": f"""WITH {_TURNS}, b AS (SELECT *, place / greatest(n - 1, 1) AS p FROM s),
c AS (SELECT conv_id, turn, place, place >= n AS late, CASE WHEN place < n THEN ((1 - p / 2) * score + (0.5 + p / 2) * rr) / ((1 - p / 2) + (0.5 + p / 2)) ELSE score END AS score, CASE WHEN place < n THEN rr END AS rr FROM b)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY late, CASE WHEN late THEN place ELSE 0 END, score DESC, place) - 1 AS INTEGER) AS position, round(score, 8) AS score, round(rr, 8) AS rerank FROM c""",
    "llm_score_parse": "SELECT event_id, array_to_string(list_transform(list_slice([least(1.0, greatest(0.0, value)), least(1.0, user_id / 100.0), 0.0, 0.25, 0.0, 0.0, 0.0], 1, CAST(1 + event_id % 7 AS INTEGER)), lambda x: printf('%.4f', CAST(x AS DOUBLE))), ' ') AS scores FROM events",
    "expansion_parse": "SELECT conv_id, turn, ['lex', 'vec', 'hyde'][CAST(turn % 4 AS INTEGER) + 1] AS type, role || ' ' || turn AS text FROM conversations WHERE turn % 4 < 3 AND role || ' ' || turn <> 'user 0'",
    "file_upsert_changed": f"""WITH {FILES}, a AS (SELECT * FROM files WHERE id % 7 <> 3), b AS (SELECT path, CASE WHEN id % 5 = 0 THEN sha256(hash || 'x') ELSE hash END AS hash FROM files WHERE id % 11 <> 5)
SELECT path, CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'new' WHEN a.hash = b.hash AND active = 1 THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path)""",
    "file_upsert_rows": f"""WITH {FILES}, a AS (SELECT * FROM files WHERE id % 7 <> 3), b AS (SELECT path, CASE WHEN id % 5 = 0 THEN sha256(hash || 'x') ELSE hash END AS hash FROM files WHERE id % 11 <> 5)
SELECT path, coalesce(b.hash, a.hash) AS hash, CAST(CASE WHEN b.hash IS NULL THEN active ELSE 1 END AS INTEGER) AS active, a.hash IS NULL AS is_new FROM a FULL JOIN b USING (path)""",
    "deleted_files_anti": f"WITH {FILES} SELECT id, path FROM files WHERE id % 7 <> 3 AND active = 1 AND id % 11 = 5",
}
_LINES = """l AS (SELECT doc_id AS file_id, unnest(x) AS content, generate_subscripts(x, 1) - 1 AS seq FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
o AS (SELECT file_id * 100000 + seq AS id, file_id, seq, sha256(content) AS hash FROM l),
n AS (SELECT file_id, seq, sha256(CASE WHEN seq % 5 = 2 THEN content || '!' ELSE content END) AS hash FROM l WHERE seq % 11 <> 7),
o1 AS (SELECT file_id, hash, min(id) AS id FROM o GROUP BY 1, 2), n1 AS (SELECT file_id, hash, min(seq) AS seq FROM n GROUP BY 1, 2),
re AS (SELECT o1.id, n1.seq AS new_seq, file_id FROM o1 JOIN n1 USING (file_id, hash))"""
SQL |= {
    "chunk_diff_reuse": f"WITH {_LINES} SELECT id, CAST(new_seq AS INTEGER) AS new_seq FROM re",
    "chunk_diff_deleted": f"WITH {_LINES} SELECT id FROM o WHERE id NOT IN (SELECT id FROM re)",
    "chunk_diff_inserted": f"WITH {_LINES} SELECT file_id, CAST(seq AS INTEGER) AS seq, hash FROM n WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.file_id = n.file_id AND re.new_seq = n.seq)",
    "unembedded_chunks": f"WITH {FILES} SELECT id, path AS file_path, language FROM files WHERE id NOT IN (SELECT vec_id FROM embeddings)",
    "cleanup_orphans": "SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 0",
    "orphan_vectors": "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)",
    "deactivate_files": f"WITH {FILES} SELECT id, CAST(CASE WHEN path LIKE 'src1/%' THEN 0 ELSE active END AS INTEGER) AS active FROM files",
    "stats": "SELECT CAST(1 AS BIGINT) AS repositories, (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS active_files, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings) AS pending",
    "get_file_chunks": "SELECT 'conv_' || conv_id AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, turn, md5(text) AS digest FROM conversations",
    "get_chunk": f"WITH {FILES} SELECT id, path AS file_path, CAST(active AS INTEGER) AS active, CAST(0 AS INTEGER) AS seq, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line FROM files JOIN documents ON doc_id = id",
    "long_line_split": "SELECT doc_id, CAST(k AS INTEGER) AS part, md5(substr(text, CAST(k AS BIGINT) * 3600 + 1, 3600)) AS digest, CAST(length(substr(text, CAST(k AS BIGINT) * 3600 + 1, 3600)) AS INTEGER) AS n FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 3600.0) AS BIGINT))) AS k FROM documents) WHERE trim(substr(text, CAST(k AS BIGINT) * 3600 + 1, 3600), ' ') <> ''",
}

_TALKS = """t AS (SELECT conv_id, turn, text, role, 'conv_' || conv_id || '.md' AS path, sha256(CAST(conv_id AS VARCHAR)) AS hash, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE 1 END AS active FROM conversations),
old AS (SELECT *, text AS now, conv_id % 3 = 0 AS touched FROM t),
new AS (SELECT *, CASE WHEN touched AND turn % 4 = 2 THEN text || '!' ELSE text END AS c FROM old WHERE NOT touched OR turn % 5 <> 4),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, row_number() OVER (PARTITION BY conv_id, c ORDER BY turn) AS occ FROM new),
kept AS (SELECT p.*, NOT touched OR (occ = 1 AND EXISTS (SELECT 1 FROM old WHERE old.conv_id = p.conv_id AND old.text = p.c)) AS reused FROM placed p)"""
_STORED = f"SELECT (SELECT count(DISTINCT path) FROM t) AS files, (SELECT count(*) FROM kept WHERE active = 1) AS live, (SELECT count(*) FROM kept WHERE active = 0) AS dead, (SELECT count(*) FROM kept WHERE active = 1 AND reused) AS live_v, (SELECT count(*) FROM kept WHERE active = 0 AND reused) AS dead_v"
SQL |= {
    "store_repository": "SELECT * FROM (VALUES ('main', '/conversations', 'c0ffee'), ('main', '/conversations', 'c0ffee')) v(id, path, last_commit)",
    "store_files": f"WITH {_TALKS} SELECT DISTINCT path, hash, 'markdown' AS language, CAST(1 AS INTEGER) AS active FROM t WHERE active = 1",
    "store_file_lookup": f"WITH {_TALKS} SELECT DISTINCT path, hash, CAST(active AS INTEGER) AS active FROM t WHERE conv_id = 1",
    "store_chunks": f"WITH {_TALKS} SELECT path, seq, role AS name, md5(c) AS digest, reused FROM kept",
    "store_file_chunks": f"WITH {_TALKS}, first AS (SELECT conv_id, c, min(turn) AS turn FROM (SELECT conv_id, text AS c, turn FROM old) GROUP BY 1, 2) SELECT seq, CAST(CASE WHEN reused THEN o.line ELSE seq + 1 END AS INTEGER) AS start_line, CAST(CASE WHEN reused THEN o.line ELSE seq + 1 END AS INTEGER) AS end_line, role AS name, md5(kept.c) AS digest FROM kept LEFT JOIN (SELECT f.conv_id, f.c, l.line FROM first f JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM old) l USING (conv_id, turn)) o ON o.conv_id = kept.conv_id AND o.c = kept.c WHERE kept.conv_id = 3",
    "store_chunk": f"WITH {_TALKS} SELECT path AS file_path, 'main' AS repo_id, 'markdown' AS language, seq, md5(c) AS digest FROM kept WHERE conv_id = 3 AND seq = 0",
    "store_vectors": f"WITH {_TALKS} SELECT path, seq, length(c) AS size, 'sizes' AS model FROM kept WHERE reused",
    "store_unembedded": f"WITH {_TALKS} SELECT path AS file_path, md5(c) AS digest FROM kept WHERE NOT reused",
    "store_stats": f"WITH {_TALKS}, s AS ({_STORED}) SELECT CAST(1 AS BIGINT) AS repositories, files, (SELECT count(DISTINCT path) FROM t WHERE active = 1) AS active_files, live + dead AS chunks, live_v + dead_v AS embedded, live + dead - live_v - dead_v AS pending FROM s",
    "store_cleanup": f"WITH {_TALKS}, s AS ({_STORED}) SELECT CAST(dead AS INTEGER) AS deleted_chunks, CAST(dead_v AS INTEGER) AS deleted_vectors, files, live AS chunks, live_v AS embedded, live - live_v AS pending FROM s",
    "store_clear": f"WITH {_TALKS}, s AS ({_STORED}) SELECT 'vectors' AS cleared, CAST(1 AS BIGINT) AS repositories, files, live + dead AS chunks, CAST(0 AS BIGINT) AS embedded FROM s UNION ALL SELECT 'all', 1, 0, 0, 0",
    "store_search": f"""WITH {_TALKS}, w AS (SELECT path, seq, c, active, {WORDS.format("c")} AS a, {WORDS.format("role")} AS b FROM kept),
d AS (SELECT path, c, active, len(a) + len(b) AS len, len(list_filter(a, lambda x: x = 'thble')) + len(list_filter(b, lambda x: x = 'thble')) AS f FROM w),
st AS (SELECT CAST(sum(len) AS DOUBLE) / count(*) AS avgdl, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (f > 0) AS DOUBLE) AS df FROM d)
SELECT DISTINCT path AS file_path, md5(c) AS digest, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl)), 8) AS rank FROM d, st WHERE f > 0 AND active = 1""",
    "store_search_prefix_near": f"""WITH {_TALKS}, w AS (SELECT path, c, {WORDS.format("c")} AS a FROM kept WHERE active = 1),
k AS (SELECT path, c, unnest(a) AS x, generate_subscripts(a, 1) AS p FROM w)
SELECT DISTINCT k.path AS file_path, md5(k.c) AS digest FROM k JOIN k j ON j.path = k.path AND j.c = k.c AND k.x = 'the' AND starts_with(j.x, 'th') AND abs(j.p - k.p) <= 2""",
    "scan_directory": "WITH f AS (SELECT n_nationkey % 9 AS k, lower(replace(n_name, ' ', '_')) AS n, sha256(n_name || ' é' || chr(10)) AS hash FROM nation) SELECT CASE k WHEN 0 THEN 'src/' || n || '.ts' WHEN 1 THEN n || '.py' ELSE 'docs/deep/' || n || '.md' END AS path, CASE k WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'markdown' END AS language, hash FROM f WHERE k < 3",
    "syntax_languages": "WITH d AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {i}, '{t}', '{n}', {a}, {b})" for k, (_, _, rows) in enumerate(SOURCES) for i, (t, n, a, b) in enumerate(rows))
    + f") v(k, seq, chunk_type, name, a, b)) SELECT doc_id AS file_id, CAST(seq AS INTEGER) AS seq, chunk_type, replace(name, '@', CAST(doc_id AS VARCHAR)) AS name, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM documents JOIN d ON k = doc_id % {len(SOURCES)}",
}
