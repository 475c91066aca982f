"""Facts of one JavaScript/TypeScript text: imports, bindings, functions, calls and branch spans.

A helper for the extraction scan: positions only, over a token list. Calls are
attributed to functions and branches by Spark, from the spans given here. Calls
inside template literals and markup, and generic calls ``f<T>()``, are not seen.
"""

from __future__ import annotations

import re

from archlake.functions.source_text import TOKEN

_NOT_CALLED = set("if for while switch catch function return typeof await new super import require void delete in of do else yield throw case async".split())
_WORD = re.compile(r"[A-Za-z_$][\w$]*\Z|[^\W\d][\w$]*\Z")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = set("public private protected static async get set readonly abstract override declare".split())


class Text:
    def __init__(self, text: str):
        self.text = text
        spans = [(m.group().strip(), m.start() + len(m.group()) - len(m.group().lstrip()), m.end()) for m in TOKEN.finditer(text)]
        # words and numbers that touch are one identifier
        self.t: list[str] = []
        self.s: list[int] = []
        self.e: list[int] = []
        for w, s, e in spans:
            if w[:2] in ("//", "/*") and len(w) > 1:
                continue
            if self.t and s == self.e[-1] and _WORD.match(self.t[-1]) and re.match(r"[\w$]", w):
                self.t[-1] += w
                self.e[-1] = e
                continue
            self.t.append(w)
            self.s.append(s)
            self.e.append(e)
        self.t += ["", "", ""]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, w in enumerate(self.t):
            if w in _OPEN:
                stack.append(i)
            elif w in (")", "]", "}"):
                while stack and _OPEN[self.t[stack[-1]]] != w:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i
        self.n = len(self.t) - 3
        self.depth = [0] * (self.n + 1)
        d = 0
        for i in range(self.n):
            d -= self.t[i] in (")", "]", "}")
            self.depth[i] = max(0, d)
            d = max(0, d) + (self.t[i] in _OPEN)

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and _WORD.match(self.t[i]) is not None

    def string(self, i: int) -> bool:
        return self.t[i][:1] in ("'", '"', "`") and self.t[i] != ""

    def slice(self, i: int, j: int) -> str:
        """Source text of the tokens i to j (exclusive)."""
        return self.text[self.s[i] : self.e[j - 1]] if j > i else ""

    def split(self, i: int, j: int) -> list[tuple[int, int]]:
        """Token ranges between the top-level commas of i to j."""
        out, start, k, angle = [], i, i, 0
        while k < j:
            if self.t[k] in _OPEN and k in self.match:
                k = self.match[k]
            elif self.t[k] == "<":
                angle += 1
            elif self.t[k] == ">" and self.t[k - 1] != "=":
                angle = max(0, angle - 1)
            elif self.t[k] == "," and not angle:
                out.append((start, k))
                start = k + 1
            k += 1
        return [x for x in [*out, (start, j)] if x[1] > x[0]]

    def statement_end(self, i: int) -> int:
        """Index behind the statement that begins at i."""
        if self.t[i] == "{" and i in self.match:
            return self.match[i] + 1
        while i < self.n and self.t[i] not in (";", "}", ")", "]"):
            i = self.match.get(i, i) + 1 if self.t[i] in _OPEN else i + 1
        return min(self.n, i + (self.t[i] == ";"))


def unquote(s: str) -> str:
    return s.strip("\"'`")


def imports(x: Text) -> list[tuple[str, bool]]:
    """(specifier, is_reexport) of import, export-from, require and dynamic import with a literal specifier."""
    out = []
    for i in range(x.n):
        w = x.t[i]
        if w in ("import", "require") and x.t[i - 1] != "." and x.t[i + 1] == "(" and x.string(i + 2) and x.t[i + 3] in (")", ","):
            out.append((unquote(x.t[i + 2]), False))
        elif w in ("import", "export") and x.t[i + 1] != "(":
            j = i + 1
            while j < x.n and (x.word(j) and x.t[j] not in ("from", "import", "export", "const", "function", "class") or x.t[j] in ("*", ",")) or x.t[j] == "{":
                j = x.match.get(j, x.n) + 1 if x.t[j] == "{" else j + 1
            if x.t[j] == "from" and x.string(j + 1):
                out.append((unquote(x.t[j + 1]), w == "export"))
            elif w == "import" and j == i + 1 and x.string(j):
                out.append((unquote(x.t[j]), False))
    return [o for o in out if o[0]]


def bindings(x: Text) -> list[tuple[str, str, str]]:
    """(local_name, imported_name, specifier) of top-level imports; ``default`` and ``*`` stand for default and namespace."""
    out = []
    for i in range(x.n):
        if x.t[i] != "import" or x.depth[i] or x.t[i + 1] == "(":
            continue
        j, found = i + 1, []
        while j < x.n and x.t[j] != "from" and not x.string(j):
            if x.t[j] == "*" and x.t[j + 1] == "as":
                found.append((x.t[j + 2], "*"))
                j += 3
            elif x.t[j] == "{" and j in x.match:
                for a, b in x.split(j + 1, x.match[j]):
                    a += x.t[a] == "type" and b - a > 1
                    found.append((x.t[b - 1], x.t[a]))
                j = x.match[j] + 1
            else:
                if x.word(j) and not (x.t[j] == "type" and x.t[j + 1] != "from"):
                    found.append((x.t[j], "default"))
                j += 1
        if x.t[j] == "from" and x.string(j + 1):
            out += [(a, b, unquote(x.t[j + 1])) for a, b in found]
    return out


def _params(x: Text, i: int) -> list[tuple[str, str | None, bool]]:
    """(name, type, optional) between the parentheses at i; untyped defaults and patterns are left out."""
    out = []
    for a, b in x.split(i + 1, x.match[i]):
        rest = x.t[a] == "." and x.t[a + 1] == "." and x.t[a + 2] == "."
        a += 3 * rest
        while x.t[a] in _MODIFIERS and b - a > 1 and x.word(a + 1):
            a += 1
        name_end = x.match.get(a, a) + 1 if x.t[a] in _OPEN else a + 1
        name, k = x.slice(a, name_end), name_end
        optional = k < b and x.t[k] == "?"
        k += optional
        kind = None
        if k < b and x.t[k] == ":":
            stop = next((q for q in range(k + 1, b) if x.t[q] == "=" and x.t[q + 1] != ">" and x.depth[q] == x.depth[a]), b)
            kind = x.slice(k + 1, stop).strip() or None
        elif k < b or x.t[a] in _OPEN:
            continue
        out.append(("..." + name if rest else name, kind, optional or rest))
    return out


def _return_type(x: Text, i: int, stops: tuple[str, ...]) -> tuple[str | None, int]:
    """The annotation that begins at i (``:``), and the index of the stop behind it."""
    if x.t[i] != ":":
        return None, i
    j = i + 1
    if x.t[j] == "{" and j in x.match:
        j = x.match[j] + 1
    while j < x.n and not (x.t[j] in stops and (x.t[j] != "=" or x.t[j + 1] == ">")):
        j = x.match[j] + 1 if x.t[j] in ("(", "[") and j in x.match else j + 1
    return x.slice(i + 1, j).strip() or None, j


def functions(x: Text) -> list[dict]:
    """Named functions, function expressions, function-valued variables and class methods, by position."""
    out = []
    classes = []
    for i in range(x.n):
        if x.t[i] == "class" and x.t[i - 1] != "." and (x.word(i + 1) or x.t[i + 1] == "{"):
            j = i + 1
            while j < x.n and x.t[j] != "{":
                j += 1
            if j in x.match:
                name = x.t[i + 1] if x.word(i + 1) and x.t[i + 1] != "extends" else None
                classes.append((j, x.match[j], name, "export" in x.t[max(0, i - 3) : i] and x.depth[i] == 0))

    def add(name, i, body, params, kind, exported=False, default=False, cls=None, name_at=-1):
        end = x.match[body] + 1 if x.t[body] == "{" and body in x.match else x.statement_end(body)
        end -= x.t[end - 1] == ";" and end > body + 1
        out.append({"name": name, "start": x.s[i], "end": x.e[min(end, x.n) - 1], "exported": exported, "is_default": default, "is_method": cls is not None, "class_name": cls, "params": params, "return_type": kind, "name_at": name_at})

    for i in range(x.n):
        before = x.t[max(0, i - 3) : i]
        exported = "export" in before and x.depth[i] == 0 and not {";", "}"} & set(before[before.index("export") :])
        if x.t[i] == "function" and x.t[i - 1] != ".":
            j = i + 1 + (x.t[i + 1] == "*")
            name = x.t[j] if x.word(j) else None
            j += name is not None
            while j < x.n and x.t[j] != "(":
                j += 1
            if j not in x.match:
                continue
            kind, body = _return_type(x, x.match[j] + 1, ("{", ";"))
            bound = x.t[i - 1] == "=" or (x.t[i - 1] == "async" and x.t[i - 2] == "=")
            if x.t[body] == "{" and not bound:
                default = exported and "default" in before
                add(name or ("default" if default else "anonymous"), i - (x.t[i - 1] == "async"), body, _params(x, j), kind, exported, default)
        elif x.t[i] in ("const", "let", "var") and x.word(i + 1):
            j = i + 2
            while j < x.n and not (x.t[j] == "=" and x.t[j + 1] != ">") and x.t[j] not in (";", "{", "}", ")"):
                j += 1
            if x.t[j] != "=":
                continue
            value = j + 1
            k = value + (x.t[value] == "async")
            default = exported and "default" in before
            if x.t[k] == "function":
                p = k + 1
                while p < x.n and x.t[p] != "(":
                    p += 1
                kind, body = _return_type(x, x.match.get(p, x.n) + 1, ("{", ";"))
            elif x.t[k] == "(" and k in x.match:
                p = k
                kind, body = _return_type(x, x.match[p] + 1, ("=", ";"))
                if x.t[body] != "=" or x.t[body + 1] != ">":
                    continue
                body += 2
            elif x.word(k) and x.t[k + 1] == "=" and x.t[k + 2] == ">":
                add(x.t[i + 1], value, k + 3, [], None, exported, default)
                continue
            else:
                continue
            if body < x.n:
                add(x.t[i + 1], value, body, _params(x, p), kind, exported, default)
    for open_, close, cls, exported in classes:
        j = open_ + 1
        while j < close:
            k = j
            while x.t[k] in _MODIFIERS and x.word(k + 1):
                k += 1
            k += x.t[k] in ("*", "#")
            if (x.word(k) or x.string(k)) and x.t[k + 1] == "(" and k + 1 in x.match:
                kind, body = _return_type(x, x.match[k + 1] + 1, ("{", ";"))
                if x.t[body] == "{" and body in x.match:
                    add(f"{cls}.{x.t[k]}" if cls else x.t[k], j, body, _params(x, k + 1), kind, exported, False, cls or "", x.s[k])
                    j = x.match[body] + 1
                    continue
            j = (x.match.get(j, j) if x.t[j] in _OPEN else j) + 1
    return sorted(out, key=lambda f: f["start"])


def calls(x: Text, names: set[int]) -> list[dict]:
    """Every call expression: its position, text, root, member path and argument texts. ``names``: positions of method names, which are no calls."""
    out = []
    for k in range(1, x.n):
        if x.t[k] != "(" or k not in x.match or not (x.word(k - 1) or x.t[k - 1] in (")", "]")):
            continue
        if x.t[k - 1] in _NOT_CALLED or x.t[k - 2] == "function" or (x.t[k - 2] == "*" and x.t[k - 3] == "function"):
            continue
        i, path = k - 1, []
        while True:
            if x.t[i] in (")", "]"):
                i = x.match.get(i, 0)
                if not (x.word(i - 1) and x.t[i - 1] not in _NOT_CALLED or x.t[i - 1] in (")", "]")):
                    break
                i -= 1
            elif x.t[i - 1] == "." and i >= 2:
                i -= 2 + (x.t[i - 2] == "?")
            else:
                break
        if x.t[k - 1] in (")", "]") and i == x.match.get(k - 1) and x.t[i] == "(" and x.t[i - 1] in ("if", "for", "while", "switch", "catch"):
            continue  # a parenthesised statement behind a condition
        if x.t[i - 1] == "new" and i + 1 == k or x.s[i] in names:
            continue
        p = k - 1
        while x.word(p) and x.t[p - 1] == "." and p - 2 >= i:
            path.insert(0, x.t[p])
            p -= 2 + (x.t[p - 2] == "?")
        args = [x.slice(a, b) for a, b in x.split(k + 1, x.match[k])]
        out.append({"start": x.s[i], "callee_text": x.slice(i, k), "callee_root": x.slice(i, p + 1), "member_path": path, "arg_texts": args})
    return sorted(out, key=lambda c: (c["start"], len(c["callee_text"])))


def branches(x: Text) -> list[tuple[int, int]]:
    """Spans of if, for, while, do, switch, try, catch and conditional expressions."""
    out = []
    for i in range(x.n):
        w = x.t[i]
        if x.t[i - 1] == ".":
            continue
        if w in ("if", "for", "while", "switch") and (x.t[i + 1] == "(" or x.t[i + 2] == "("):
            j = x.match.get(i + 1 if x.t[i + 1] == "(" else i + 2)
            if j is None or (w == "while" and x.t[i - 1] == "}" and x.t[j + 1] == ";"):
                continue
            end = x.statement_end(j + 1)
            while w == "if" and x.t[end] == "else":
                end += 1
                if x.t[end] == "if" and end + 1 in x.match:
                    end = x.match[end + 1] + 1
                end = x.statement_end(end)
        elif w in ("do", "try", "catch") and (x.t[i + 1] == "{" or w == "catch"):
            j = i + 1 if x.t[i + 1] == "{" else x.match.get(i + 1, x.n) + 1
            end = x.match.get(j, x.n - 1) + 1
            while w == "try" and x.t[end] in ("catch", "finally"):
                j = end + 1 if x.t[end + 1] == "{" else x.match.get(end + 1, x.n) + 1
                end = x.match.get(j, x.n - 1) + 1
        elif w == "?" and x.t[i + 1] not in (".", "?", ":", ",", ")") and x.t[i - 1] != "?":
            stops = (";", "{", "}", "(", "[", ",", "=", "return", ":")
            a = i - 1
            while a > 0 and x.t[a] not in stops:
                a = x.match.get(a, a) - 1 if x.t[a] in (")", "]") else a - 1
            end = i
            while end < x.n and x.t[end] not in (";", ",", ")", "]", "}"):
                end = x.match[end] + 1 if x.t[end] in _OPEN and end in x.match else end + 1
            out.append((x.s[a + 1], x.e[end - 1]))
            continue
        else:
            continue
        out.append((x.s[i], x.e[min(end, x.n) - 1]))
    return out


def type_declarations(text: str) -> list[tuple[str, str, bool, bool]]:
    """(name, body, is_interface, exported) of type and interface lines; a later one of equal name wins."""
    found: dict[str, tuple[str, str, bool, bool]] = {}
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        m = re.match(r"\s*(export )?\s*(type|interface) \s*([^\s=<{]+)", lines[i])
        i += 1
        if not m:
            continue
        if m[2] == "type":
            head, eq, body = lines[i - 1].partition("=")
            if not eq:
                continue
            body, last = body.strip(), i
            while not body.endswith(";") and last < len(lines) and last - i < 20:
                body += " " + lines[last].strip()
                last += 1
            i = last
            found[m[3]] = (m[3], body.rstrip(";").strip(), False, bool(m[1]))
        else:
            rest = "\n".join([lines[i - 1][m.end() :].strip(), *(s.strip() for s in lines[i:])])
            depth = 0
            for k, c in enumerate(rest):
                depth += (c == "{") - (c == "}")
                if c == "}" and depth == 0:
                    found[m[3]] = (m[3], rest[rest.index("{") + 1 : k].strip(), True, bool(m[1]))
                    i += rest.count("\n", 0, k)
                    break
    return list(found.values())
