"""The request interface: the same calls and JSON answers as a node serves."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .config import MAX_FULL, MAX_POSTS, Config, clamp
from .functions.names import name_of
from .functions.text import truncated
from .operators.authors import named, thematic_authors
from .operators.feed import chain_list, embedding_updates, feed_headers, names_of_posts, sync_settings
from .operators.search import Corpus, nearest_to_post, nearest_to_text, posts_of

# The parameters of requests: type, default (none: required), bounds.
PARAMETERS = {
    "q": ("string", None, {}), "topic": ("string", None, {}), "author": ("string", None, {}), "permlink": ("string", None, {}), "posts": ("array", None, {}),
    "truncate": ("integer", 0, {"minimum": 0, "maximum": 65535}), "result_limit": ("integer", 100, {"minimum": 1, "maximum": MAX_POSTS}), "full_posts": ("integer", 10, {"minimum": 0, "maximum": MAX_FULL}),
    "observer": ("string", "", {}), "after_seq": ("integer", None, {"minimum": 0}), "page_size": ("integer", 1000, {"minimum": 1}), "sync_uuid": ("string", None, {}),
}
# The routes: method, parameters, schema of the answer.
ROUTES = {
    "/": ("get", (), "Document"), "/posts/search": ("get", ("q", "truncate", "result_limit", "full_posts", "observer"), "Posts"),
    "/posts/{author}/{permlink}/similar": ("get", ("author", "permlink", "truncate", "result_limit", "full_posts", "observer"), "Posts"), "/authors/search": ("get", ("topic", "result_limit", "observer"), "Names"),
    "/posts/by-ids": ("post", ("posts", "truncate", "observer"), "Posts"), "/posts/by-ids-query": ("get", ("posts", "truncate", "observer"), "Posts"),
    "/embedding-updates": ("get", ("after_seq", "page_size", "sync_uuid"), "Operations"), "/sync-settings": ("get", (), "Settings"), "/sync-chains": ("get", (), "Chains"), "/version": ("get", (), "Version"), "/sync-status": ("get", (), "Status"),
}


def _object(**fields: str) -> dict[str, Any]:
    return {"type": "object", "properties": {k: {"type": v} if v != "vectors" else {"type": "array", "items": {"type": "array", "items": {"type": "number"}}} for k, v in fields.items()}}


def _list(item: dict[str, Any]) -> dict[str, Any]:
    return {"type": "array", "items": item}


_SETTINGS = {"sync_uuid": "string", "llm": "string", "embedding_dimensionality": "integer", "document_prefix": "string", "query_prefix": "string", "tokens_per_chunk": "integer", "overlap_amount": "number", "min_token_threshold": "integer", "max_embeddings_per_post": "integer", "skipped_op_count": "integer"}
ANSWERS = {
    "Document": {"type": "object"}, "Names": {"oneOf": [_list({"type": "string"}), {"type": "object", "maxProperties": 0}]}, "Version": {"type": "string"},
    "Posts": _list({"oneOf": [_object(author="string", permlink="string", post_id="integer", title="string", body="string", similarity="number"), _object(author="string", permlink="string"), {"type": "null"}]}),
    "Operations": _list(_object(sync_seq="integer", op="string", author="string", permlink="string", number_of_tokens="integer", last_vectors_block="integer", embeddings="vectors")),
    "Settings": _object(**_SETTINGS), "Chains": _list(_object(position="integer", priority="integer", base_url="string", note="string", **_SETTINGS)), "Status": _object(last_block_num="integer", last_block_time="string"),
}


@dataclass
class Api:
    """bodies: (post_id, title, body) of posts for full answers."""

    corpus: Corpus
    config: Config
    embed: Callable[[Sequence[str]], np.ndarray]
    bodies: DataFrame
    chains: DataFrame | None = None
    markers: DataFrame | None = None
    version_hash: str | None = None

    def observer_id(self, observer: str) -> int:
        """0 for nobody; an unknown name is an error."""
        if not observer:
            return 0
        rows = self.corpus.accounts.filter(name_of("name") == observer.strip().lower().lstrip("@")).select("id").limit(1).collect()
        if not rows:
            raise LookupError(f"no account {observer}")
        return rows[0].id

    def _posts(self, hits: DataFrame, truncate: int, full: int) -> list[dict]:
        """The first ``full`` posts whole, the rest by name, in order of similarity."""
        names = names_of_posts(self.corpus.posts, self.corpus.accounts, self.corpus.permlinks)
        found = hits.join(names, "post_id")
        whole = F.broadcast(hits.filter(F.col("similarity_order") <= full).select("post_id"))  # at most 50
        body = self.bodies.select("post_id", "title", truncated("body", truncate).alias("body")).join(whole, "post_id", "left_semi")
        rows = found.join(body, "post_id", "left").orderBy("similarity_order").collect()  # at most 1000
        out = []
        for r in rows:
            stub = {"author": r.author, "permlink": r.permlink}
            out.append(stub | {"post_id": r.post_id, "title": r.title, "body": r.body, "similarity": r.similarity} if r.similarity_order <= full else stub)
        return out

    def _bounds(self, result_limit: int, full_posts: int, truncate: int) -> int:
        if not 1 <= result_limit <= MAX_POSTS:
            raise ValueError(f"result_limit must be within 1..{MAX_POSTS}")
        if not 0 <= full_posts <= MAX_FULL:
            raise ValueError(f"full_posts must be within 0..{MAX_FULL}")
        if truncate < 0:
            raise ValueError("truncate must not be negative")
        return min(full_posts, result_limit)

    def posts_search(self, q: str, truncate: int = 0, result_limit: int = 100, full_posts: int = 10, observer: str = "") -> list[dict]:
        full = self._bounds(result_limit, full_posts, truncate)
        return self._posts(nearest_to_text(self.corpus, q, self.embed, self.config, result_limit, self.observer_id(observer)), truncate, full)

    def posts_similar(self, author: str, permlink: str, truncate: int = 0, result_limit: int = 100, full_posts: int = 10, observer: str = "") -> list[dict]:
        full = self._bounds(result_limit, full_posts, truncate)
        return self._posts(nearest_to_post(self.corpus, author, permlink, self.config, result_limit, self.observer_id(observer)), truncate, full)

    def authors_search(self, topic: str, result_limit: int = 10, observer: str = "") -> list[str] | dict:
        """Ordered names; the empty object, not the empty list, when there are none."""
        vec = self.embed([self.config.query_prefix + topic])[0].tolist()
        rows = named(thematic_authors(self.corpus, vec, self.config, clamp(result_limit, 1, 100), self.observer_id(observer)), self.corpus.accounts).orderBy("rank").collect()
        return [r.author for r in rows] or {}

    def posts_by_ids(self, posts: Sequence[dict], truncate: int = 10, observer: str = "", most: int = 50) -> list[dict | None]:
        """Posts in the order asked for, null for missing ones."""
        if not 1 <= len(posts) <= most:
            raise ValueError(f"posts must name 1..{most} posts")
        if any(not isinstance(p, dict) or not p.get("author") or not p.get("permlink") for p in posts):
            raise ValueError("every post needs author and permlink")
        self.observer_id(observer)
        ids = posts_of(self.corpus, [(p["author"], p["permlink"]) for p in posts])
        names = names_of_posts(self.corpus.posts, self.corpus.accounts, self.corpus.permlinks).filter(F.col("post_id").isin([i for i in ids if i is not None]))
        body = self.bodies.select("post_id", "title", truncated("body", truncate).alias("body"))
        rows = {r.post_id: r.asDict() for r in names.join(body, "post_id", "left").collect()}
        return [rows.get(i) for i in ids]

    def posts_by_ids_query(self, text: str, truncate: int = 10, observer: str = "") -> list[dict | None]:
        try:
            posts = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"posts isn't JSON: {e}") from e
        if not isinstance(posts, list):
            raise ValueError("posts must be a JSON array")
        return self.posts_by_ids(posts, truncate, observer, 10)

    def embedding_updates(self, after_seq: int, page_size: int, sync_uuid: str, current_block: int = 0) -> tuple[list[dict], dict[str, str]]:
        names = names_of_posts(self.corpus.posts, self.corpus.accounts, self.corpus.permlinks)
        page = embedding_updates(self.corpus.vectors, self.markers, self.corpus.post_data, names, self.config, after_seq, page_size, sync_uuid)
        return [r.asDict(True) for r in page.collect()], feed_headers(self.config, current_block)

    def sync_settings(self) -> dict[str, Any]:
        return sync_settings(self.config)

    def sync_chains(self) -> list[dict]:
        own = self.chains.sparkSession.createDataFrame([{**{c: None for c in self.chains.columns}, **{k: v for k, v in self.sync_settings().items() if k in self.chains.columns}}], self.chains.schema)
        return [r.asDict() for r in chain_list(own, self.chains).orderBy("position").collect()]

    def version(self) -> str:
        return self.version_hash or "unspecified"

    def sync_status(self, last_block: int | None, block_time: datetime | None, ready: bool = True) -> dict[str, Any]:
        if not ready:
            raise RuntimeError("the instance is not ready")
        return {"last_block_num": last_block, "last_block_time": block_time.strftime("%Y-%m-%dT%H:%M:%S") if block_time else None}

    def openapi(self) -> dict[str, Any]:
        """The interface's own description, made from the tables of routes, parameters and answers."""
        paths: dict[str, Any] = {}
        for route, (method, names, answer) in ROUTES.items():
            call: dict[str, Any] = {"operationId": method + "".join(w.capitalize() for w in route.replace("{", "").replace("}", "").replace("-", "/").split("/")), "parameters": []}
            for name in names:
                kind, default, bounds = PARAMETERS[name]
                if kind == "array" and method == "post":
                    call["requestBody"] = {"required": True, "content": {"application/json": {"schema": _object(**{name: kind})}}}
                    continue
                schema = {"type": "string" if kind == "array" else kind, **bounds} | ({} if default is None else {"default": default})
                inside = "{" + name + "}" in route
                call["parameters"].append({"name": name, "in": "path" if inside else "query", "required": inside or default is None, "schema": schema})
            call["responses"] = {"200": {"description": answer, "content": {"application/json": {"schema": {"$ref": f"#/components/schemas/{answer}"}}}}, "400": {"description": "a parameter is refused"}, "404": {"description": "a name isn't known"}}
            paths[route] = {method: call}
        return {"openapi": "3.1.0", "info": {"title": "vecloom", "version": self.version()}, "paths": paths, "components": {"schemas": ANSWERS}}


def fresh(block_time: datetime, now: datetime | None = None, seconds: int = 60) -> bool:
    """Is the newest block at most a minute old?"""
    return ((now or datetime.now(timezone.utc).replace(tzinfo=None)) - block_time).total_seconds() <= seconds
