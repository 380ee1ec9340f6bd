"""The search service: JSON-RPC 2.0 requests, one a line, answered from an index and a document table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..plans import search as plans
from . import sinks

#: Fixed values of the protocol.
PROTOCOL, NO_METHOD, FAULT = "2024-11-05", -32601, -32603
MOST_CHARS = 20_000
TOOLS = [
    {"name": "search_corpus", "description": "Ranked passages of the document corpus for a query.",
     "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1, "maximum": 20}, "bm25_top": {"type": "integer", "minimum": 1}}, "required": ["query"]}},
    {"name": "read_document", "description": "A stretch of one converted document.",
     "inputSchema": {"type": "object", "properties": {"path": {"type": "string"}, "offset": {"type": "integer"}, "length": {"type": "integer", "maximum": MOST_CHARS}}, "required": ["path"]}},
]


class Service:
    """Answers requests from chunks and their index (``plans.search.corpus_index``) and documents (path, body)."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, index, documents: DataFrame, name: str = "folioquill"):
        self.spark, self.chunks, self.index, self.documents, self.name = spark, chunks, index, documents, name
        self.tools: dict[str, Callable[[dict], str]] = {"search_corpus": self.search, "read_document": self.read}

    def search(self, args: dict) -> str:
        query = str(args.get("query") or "").strip()
        if not query:
            return "No query given."
        k = sinks.clamp_top(int(args.get("top_k") or 5))
        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        found = plans.search_corpus(self.chunks, self.index, asked, k, candidates=max(1, int(args.get("bm25_top") or 20))).orderBy("rank").select("page", "chunk_id", "tier", "final_score", "raw_text").collect()  # at most 20 rows
        lines = [f"- {r['page']}\n  chunk {r['chunk_id']} | tier {r['tier']} | {r['final_score']:.3f}\n  {' '.join(r['raw_text'].split())[:300]}" for r in found]
        return "\n\n".join(lines) or "Nothing found."

    def read(self, args: dict) -> str:
        path = str(args.get("path") or "").strip().strip('"')
        if not path:
            return "No path given."
        offset = max(0, int(args.get("offset") or 0))
        length = max(1, min(int(args.get("length") or MOST_CHARS), MOST_CHARS))
        found = sinks.read_document(self.documents, path, offset, length).limit(1).collect()
        if not found:
            return f"Not found, or outside the collection: {path}"
        text, total = found[0]["text"], found[0]["total"]
        past = offset + len(text)
        return f"{path} — chars {offset}..{past} of {total}" + (f" (more follows from offset={past})" if past < total else "") + f"\n\n{text}"

    def answer(self, request: dict) -> dict | None:
        """The response to a request; None to a notification."""
        method, params = request.get("method"), request.get("params") or {}
        reply = {"jsonrpc": "2.0", "id": request.get("id")}
        said = lambda text, **more: reply | {"result": {"content": [{"type": "text", "text": text}]} | more}
        match method:
            case "initialize":
                return reply | {"result": {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1"}}}
            case "ping":
                return reply | {"result": {}}
            case "tools/list":
                return reply | {"result": {"tools": TOOLS}}
            case "tools/call" if params.get("name") in self.tools:
                try:
                    return said(self.tools[params["name"]](params.get("arguments") or {}))
                except Exception as fault:  # noqa: BLE001  a failing tool is an answer
                    return said(f"Tool error: {fault}", isError=True)
            case "tools/call":
                return reply | {"error": {"code": NO_METHOD, "message": f"Unknown tool: {params.get('name')}"}}
            case "initialized" | "notifications/initialized":
                return None
        return None if request.get("id") is None else reply | {"error": {"code": NO_METHOD, "message": f"Method not found: {method}"}}

    def serve(self, lines: Iterable[str], write: Callable[[str], object]) -> None:
        """Answer every line; blank ones and those that are no JSON objects are passed over."""
        for line in lines:
            try:
                request = json.loads(line)
            except ValueError:
                continue
            if not isinstance(request, dict):
                continue
            try:
                response = self.answer(request)
            except Exception as fault:  # noqa: BLE001  the loop goes on
                response = {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": FAULT, "message": str(fault)}}
            if response is not None:
                write(json.dumps(response, ensure_ascii=False) + "\n")
