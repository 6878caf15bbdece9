"""Talking about a graph through a chat backend: prompts, the four graph tools, and the log."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.functions import text as X
from loomgraph.functions.embedders import Embedder, _post
from loomgraph.operators import context, graph
from loomgraph.plans.build import Graph, ask
from loomgraph.sinks.store import log_answer


class ChatBackend(Protocol):
    name: str

    def __call__(self, system: str, message: str, tools: dict[str, Callable[..., str]]) -> str: ...


#: The arguments of the graph tools, as services want them described.
ARGUMENTS = {
    "search_nodes": {"query": "string", "limit": "integer"},
    "get_node_info": {"name": "string"},
    "find_callers": {"name": "string", "limit": "integer"},
    "find_callees": {"name": "string", "limit": "integer"},
}


class Completions:
    """A service of chat completions: the model's calls of tools are answered until it gives a text."""

    def __init__(self, model: str, key: str, url: str = "https://api.openai.com/v1/chat/completions", name: str = "completions", post: Callable = _post, turns: int = 20):
        if not key:
            raise ValueError("a key is needed")
        self.model, self.key, self.url, self.name, self.post, self.turns = model, key, url, name, post, turns

    def __call__(self, system: str, message: str, tools: dict[str, Callable[..., str]]) -> str:
        talk: list[dict] = [{"role": "system", "content": system}, {"role": "user", "content": message}]
        known = [{"type": "function", "function": {"name": n, "parameters": {"type": "object", "properties": {k: {"type": t} for k, t in ARGUMENTS[n].items()}, "required": [next(iter(ARGUMENTS[n]))]}}} for n in tools]
        for _ in range(self.turns):
            reply = self.post(self.url, {"model": self.model, "messages": talk} | ({"tools": known} if known else {}), {"Authorization": f"Bearer {self.key}"}, 120.0)
            if reply.get("error"):
                raise RuntimeError(reply["error"].get("message", "the service failed"))
            said = reply["choices"][0]["message"]
            calls = said.get("tool_calls") or []
            if not calls:
                return said.get("content") or ""
            talk.append(said)
            for call in calls:
                asked = call["function"]
                try:
                    answer = tools[asked["name"]](**json.loads(asked.get("arguments") or "{}"))
                except (KeyError, TypeError, ValueError) as e:
                    answer = f"no such call: {e}"
                talk.append({"role": "tool", "tool_call_id": call.get("id"), "content": answer})
        raise RuntimeError("the model asked for tools without end")


SYSTEM = "You help with the project {project}. Rely on the context below; say so where it isn't enough.\n\n{context}"
TOOL_SYSTEM = "You help with the project {project}. Look things up with the tools: search_nodes, get_node_info, find_callers, find_callees."


def search_nodes(g: Graph, query: str, limit: int = 10) -> list[tuple[str, int]]:
    """Names and scores of the nodes in which terms of the query occur; 50 at most."""
    score = X.search_score(query, F.col("name"), F.coalesce("signature", F.lit("")), F.coalesce("body_text", F.lit("")))
    found = g.nodes.select("name", "node_pos", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "node_pos", "name").limit(min(limit, 50))
    return [(r["name"], r.score) for r in found.collect()]


def tools(g: Graph) -> dict[str, Callable[..., str]]:
    def listed(direction: str):
        def run(name: str, limit: int = 20) -> str:
            found = graph.neighbours(g.edges, [name], direction).orderBy("neighbour").limit(limit).collect()
            return "\n".join(r.neighbour for r in found) or "none"

        return run

    def search(query: str, limit: int = 10) -> str:
        return "\n".join(f"{n} ({s})" for n, s in search_nodes(g, query, limit)) or "none"

    def info(name: str) -> str:
        one = g.nodes.where(F.col("name") == name)
        kind = one.select("node_type").first()
        if kind is None:
            return f"no node {name}"
        made = context.compressed_context(one, g.edges) if kind.node_type == S.PACKAGE else context.full_context(one)
        return made.first().context

    return {"search_nodes": search, "get_node_info": info, "find_callers": listed("in"), "find_callees": listed("out")}


def chat(g: Graph, message: str, backend: ChatBackend, use_tools: bool = False, budget: int = 6000, start: str | None = None, min_relevance: float = S.MIN_RELEVANCE, embedder: Embedder | None = None, log: Callable[[str, str], object] | None = None) -> str:
    """The backend's answer; its failure is an answer that begins with '[' and names the backend.  log gets the message
    and the first 500 characters of the answer; without one, they go to the project's log."""
    if not isinstance(message, str) or not message.strip():
        raise ValueError("a message is needed")
    project = g.meta.get("project_name", "")
    try:
        system = TOOL_SYSTEM.format(project=project) if use_tools else SYSTEM.format(project=project, context=ask(g, message, start, budget, min_relevance, embedder=embedder)["context_string"])
        answer = backend(system, message, tools(g) if use_tools else {})
    except Exception as e:  # the answer tells what went wrong
        return f"[{backend.name} error] {e}"
    if log is not None:
        log(message, answer[:500])
    else:
        log_answer(g, message, answer)
    return answer
