"""Type annotations as shapes: nested dicts with a ``kind``, written as JSON into a VARIANT."""

from __future__ import annotations

#: The primitive type names.
PRIMITIVES = frozenset("string number boolean void any unknown null undefined never object symbol bigint".split())


def split_at(text: str, stops: str, clamp: bool = False) -> list[str]:
    """Parts of ``text`` between the ``stops`` outside all brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ">)]}":
            depth = max(0, depth - 1) if clamp else depth - 1
        elif c in stops and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


class Shapes:
    """``local``: name -> (body, is_interface); ``imported``: name -> such an entry, or None if it didn't resolve."""

    def __init__(self, local: dict, imported: dict | None = None, depth: int = 2):
        self.local, self.imported, self.depth = local, imported or {}, depth

    def of(self, annotation: str | None) -> dict:
        t = (annotation or "").strip()
        return self._parse(t, self.depth, ()) if t else {"kind": "unknown", "raw": ""}

    def _parse(self, t: str, depth: int, seen: tuple[str, ...]) -> dict:
        t = t.strip()
        parse = lambda s: self._parse(s, depth, seen)
        parts = split_at(t, "|")
        if len(parts) > 1:
            return {"kind": "union", "of": [parse(p) for p in parts]}
        parts = split_at(t, "&")
        if len(parts) > 1:
            return parse(parts[0])
        if t in PRIMITIVES:
            return {"kind": "primitive", "name": t}
        if t[:1] in ("'", '"') and t.endswith(t[0]) or t in ("true", "false") or _number(t):
            return {"kind": "literal", "value": t}
        if t.endswith("[]"):
            return {"kind": "array", "of": parse(t[:-2])}
        if t.startswith("[") and t.endswith("]"):
            return {"kind": "tuple", "of": [parse(p) for p in split_at(t[1:-1], ",")]}
        if t.startswith("{") and t.endswith("}"):
            return {"kind": "object", "fields": self._fields(t[1:-1], depth, seen)}
        if "<" in t and t.endswith(">"):
            name, args = t[: t.index("<")], t[t.index("<") + 1 : -1]
            if name == "Array":
                return {"kind": "array", "of": parse(args)}
            return {"kind": "ref", "name": name.strip(), "args": [parse(a) for a in split_at(args, ",")], "external": False}
        if depth > 0 and t not in seen:
            declared = self.local.get(t) or self.imported.get(t)
            if declared:
                body, interface = declared
                if interface:
                    return {"kind": "object", "fields": self._fields(body, depth - 1, (*seen, t))}
                return self._parse(body, depth - 1, (*seen, t))
            if t in self.imported:
                return {"kind": "ref", "name": t, "args": [], "external": True}
        return {"kind": "ref", "name": t, "args": [], "external": False}

    def _fields(self, body: str, depth: int, seen: tuple[str, ...]) -> list[dict]:
        out = []
        for part in split_at(body, ";,\n", clamp=True):
            part = part.strip()
            if not part or part.startswith(("//", "/*", "[")) or "(" in part:
                continue
            part = part.removeprefix("readonly").strip()
            pieces = split_at(part, ":")
            if len(pieces) < 2:
                continue
            key, value = pieces[0].strip(), part[len(pieces[0]) + 1 :].strip()
            name = key.rstrip("?").strip()
            if name and " " not in name:
                out.append({"name": name, "optional": key.endswith("?"), "shape": self._parse(value, depth, seen)})
        return out


def _number(t: str) -> bool:
    try:
        float(t)
    except ValueError:
        return False
    return "_" not in t


def render(s: dict) -> str:
    """The shape as text."""
    kind = s["kind"]
    if kind == "primitive":
        return s["name"]
    if kind == "literal":
        return s["value"]
    if kind == "array":
        inner = render(s["of"])
        return f"({inner})[]" if s["of"]["kind"] == "union" else f"{inner}[]"
    if kind == "union":
        return " | ".join(map(render, s["of"]))
    if kind == "tuple":
        return "[" + ", ".join(map(render, s["of"])) + "]"
    if kind == "object":
        return "{ " + "; ".join(f"{f['name']}{'?' * f['optional']}: {render(f['shape'])}" for f in s["fields"]) + " }" if s["fields"] else "{}"
    if kind == "ref":
        return s["name"] + ("<" + ", ".join(map(render, s["args"])) + ">" if s["args"] else "")
    return s.get("raw") or "unknown"
