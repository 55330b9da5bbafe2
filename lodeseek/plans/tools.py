"""Tools for assistants over standard input and output, as JSON-RPC lines."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.filters import apply_filters, parse_query
from .search import FILTERED, Searcher
from .store import Store


def place(r) -> str:
    lines = f":{r['start_line']}-{r['end_line'] if r['end_line'] is not None else ''}" if r["start_line"] is not None else ""
    return f"{lines}{f' ({r["name"]})' if r['name'] else ''}{f' [{r["chunk_type"]}]' if r['chunk_type'] else ''}"


def fenced(head: str, detail: str, content: str) -> str:
    return f"## {head}\n{detail}\n```\n{content}\n```"


class Tools:
    """search, query, get_file, get_chunk and status; each returns Markdown."""

    def __init__(self, store: Store, searcher: Callable[[], Searcher], collection: str = ""):
        self.store, self._make, self._searcher, self.collection = store, searcher, None, collection

    @property
    def searcher(self) -> Searcher:
        self._searcher = self._searcher or self._make()
        return self._searcher

    def search(self, query: str, limit: int = 10) -> str:
        limit = max(1, min(100, limit))
        text, filters = parse_query(query)
        if not text:
            raise ValueError("the query has no text besides its filters")
        rows = self.store.search_bm25(text, limit * (FILTERED if filters else 1))
        hits = apply_filters(rows, filters).orderBy("rank", "chunk_id").limit(limit).collect()  # at most 100 rows
        return "\n\n".join(fenced(r["file_path"] + place(r), f"Chunk ID: {r['chunk_id']} | rank: {r['rank']}", r["content"]) for r in hits) or "No results found."

    def query(self, query: str, limit: int = 10, expand: bool | None = None, rerank: bool | None = None) -> str:
        limit = max(1, min(100, limit))
        if not parse_query(query)[0]:
            raise ValueError("the query has no text besides its filters")
        s, able = self.searcher, self.searcher.model is not None
        got = s.search(query, "hybrid" if s.embedder else "bm25", limit, able if expand is None else expand, able if rerank is None else rerank)
        out = []
        for r in got.results.collect():  # at most 100 rows
            scores = ", ".join(f"{k}={v:.4f}" for k, v in r["scores"].asDict().items() if v is not None)
            out.append(fenced(f"{r['file_path']}{place(r)} | score: {r['score']:.4f}", f"Chunk ID: {r['chunk_id']}" + (f"\nScores: {scores}" if scores else ""), r["content"]))
        return "\n\n".join(out) or "No results found."

    def get_file(self, path: str, repo: str | None = None) -> str:
        files = self.store.table("files").where("active = 1").where(F.col("path") == path)
        rows = (files.where(F.col("repo_id") == repo) if repo else files).orderBy("repo_id").limit(1).collect()
        if not rows:
            raise ValueError(f"no file {path}")
        f, chunks = rows[0], self.store.file_chunks(rows[0]["id"]).collect()  # of one file
        head = f"# {f['path']}\nRepository: {f['repo_id']} | language: {f['language'] or 'unknown'} | chunks: {len(chunks)}"
        return "\n\n".join([head, *(fenced(f"Chunk {c['seq']}{place(c)}", f"Chunk ID: {c['id']}", c["content"]) for c in chunks)])

    def get_chunk(self, chunk_id: int) -> str:
        rows = self.store.chunk(chunk_id).collect()
        if not rows:
            raise ValueError(f"no chunk {chunk_id}")
        r = rows[0]
        return fenced(f"{r['file_path']}{place(r)}", f"Chunk ID: {r['id']} | seq: {r['seq']}", r["content"])

    def status(self) -> str:
        r = self.store.stats().first().asDict()
        return f"# Index status {self.collection}".rstrip() + "\n" + "\n".join(f"- {k.replace('_', ' ')}: {v}" for k, v in r.items())

    def call(self, name: str, arguments: dict) -> str:
        if name not in TOOLS:
            raise ValueError(f"no tool {name}")
        return getattr(self, name)(**arguments)


_TEXT, _INT, _BOOL = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
TOOLS = {
    "search": ("Full-text search by BM25", {"query": _TEXT, "limit": _INT}, ["query"]),
    "query": ("Hybrid search by BM25 and vectors", {"query": _TEXT, "limit": _INT, "expand": _BOOL, "rerank": _BOOL}, ["query"]),
    "get_file": ("Chunks of a file", {"path": _TEXT, "repo": _TEXT}, ["path"]),
    "get_chunk": ("A chunk", {"chunk_id": _INT}, ["chunk_id"]),
    "status": ("Counts of the index", {}, []),
}


def respond(tools: Tools, message: dict) -> dict | None:
    """The answer to a JSON-RPC message; none to a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeseek", "version": "0.1.0"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    elif method == "tools/call":
        try:
            text, failed = tools.call(params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:
            text, failed = f"Error: {e}", True
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    elif method == "ping":
        result = {}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(tools: Tools, source=sys.stdin, sink=sys.stdout) -> None:
    for line in source:
        if line.strip():
            if (answer := respond(tools, json.loads(line))) is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
