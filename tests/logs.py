"""Builders of small session logs."""

from __future__ import annotations

import json


def entry(type_, id_, parent=None, **more):
    return {"type": type_, "id": id_, "parentId": parent, "timestamp": "2026-05-02T10:00:00.000Z", **more}


def message(id_, role, content, parent=None, **more):
    return entry("message", id_, parent, message={"role": role, "content": content, **more})


def call(name, args):
    return {"type": "toolCall", "id": "t", "name": name, "arguments": args}


def part(text):
    return {"type": "text", "text": text}


def custom(kind, id_, covers, **data):
    return entry("custom", id_, customType=kind, data={**data, "coversUpToId": covers})


def observation(id_, content="seen", relevance="medium", sources=("raw-1",), tokens=10):
    return {"id": id_, "content": content, "timestamp": "2026-05-02 10:00", "relevance": relevance, "sourceEntryIds": list(sources), "tokenCount": tokens}


def reflection(id_, supports, content="learnt", tokens=5):
    return {"id": id_, "content": content, "supportingObservationIds": list(supports), "tokenCount": tokens}


def write(folder, **sessions):
    for name, rows in sessions.items():
        (folder / f"{name}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(folder)
