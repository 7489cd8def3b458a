"""A bulk body read line by line, as a plain version of ``ndjson.parse_bulk``."""

import json

from tenmark.sources.ndjson import CONDITIONAL, VERBS, lines


def _object(line):
    found = json.loads(line)
    if not isinstance(found, dict):
        raise ValueError("a line is no object")
    return found


def action(line: str) -> tuple[str, dict]:
    found = _object(line)
    if len(found) != 1 or next(iter(found)) not in VERBS:
        raise ValueError("an action line has exactly one verb")
    verb, meta = next(iter(found.items()))
    return verb, meta if isinstance(meta, dict) else {}


def bulk_items(body: str) -> list[tuple]:
    """``(ordinal, action, index, id, routing, cas, source)`` of each operation; metadata that is no text is none."""
    out, rest = [], lines(body)
    for line in rest:
        verb, meta = action(line)
        source = None
        if verb != "delete":
            source = next(rest, None)
            if source is None:
                raise ValueError("an action lacks its document")
            _object(source)
        text = lambda k: meta[k] if isinstance(meta.get(k), str) else None  # noqa: E731, B023
        out.append((len(out), verb, text("_index"), text("_id"), text("routing"), any(k in meta for k in CONDITIONAL), source))
    return out
