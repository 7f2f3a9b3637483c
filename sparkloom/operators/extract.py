"""Parsing of files into symbols, references and chunks, one task function for each Arrow batch of files.

Python is parsed by its own `ast`. For other languages a lexer masks strings and comments (keeping every
offset), and rules by language find definitions, whose range ends with the matching brace or, in Ruby, `end`.
A file that can't be parsed gives a row in extract_errors; its symbols and references are none, its chunks lines.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import CHUNKS, REFS, SYMBOLS


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    start: int  # lines from 1, inclusive
    end: int
    parent: str | None


@dataclass(frozen=True)
class Ref:
    kind: str  # call or import
    name: str
    alias: str | None
    context: str | None
    line: int


# ---- lexer -------------------------------------------------------------------------------------

_HASH = {"python", "ruby", "php"}
_TICKS = {"javascript", "typescript", "go"}


#: A `/` begins a regular expression after nothing, an operator, an opening bracket or one of some words.
_REGEX_BEFORE = re.compile(r"(?:^|[=(,:\[!&|?{};+\-*%<>~^\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))[ \t]*$")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/")
_RAW = re.compile(r'b?r(#*)"')


def _template(text: str, at: int, blank, depths: list[int]) -> int:
    """Blanks template text from `at` on; the offset after its end, or within a `${`, which then is open in depths."""
    j, n = at, len(text)
    while j < n and text[j] != "`":
        if text.startswith("${", j):
            blank(at, j)
            depths.append(0)
            return j + 2
        j += 2 if text[j] == "\\" else 1
    blank(at, j)
    return j + 1


def mask(text: str, language: str) -> str:
    """The text with the insides of strings and comments blanked; line ends and length stay."""
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    script = language in ("javascript", "typescript")
    depths: list[int] = []  # braces open within each `${` that is open

    while i < n:
        c = text[i]
        two = text[i : i + 2]
        if depths and c in "{}":
            depths[-1] += 1 if c == "{" else -1
            if depths[-1] < 0:  # the template goes on
                depths.pop()
                i = _template(text, i + 1, blank, depths)
                continue
        if two == "//" and language not in ("python", "ruby") or c == "#" and language in _HASH:
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif two == "/*" and language not in ("python", "ruby"):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif language == "rust" and c in "rb" and (raw := _RAW.match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
            end = text.find('"' + raw.group(1), raw.end())
            end = n if end < 0 else end
            blank(raw.end(), end)
            i = end + 1 + len(raw.group(1))
        elif script and c == "`":
            i = _template(text, i + 1, blank, depths)
        elif script and c == "/" and _REGEX_BEFORE.search("".join(out[max(0, i - 40) : i])) and (r := _REGEX.match(text, i)):
            blank(i + 1, r.end() - 1)
            i = r.end()
        elif c in "\"'" or c == "`" and language in _TICKS:
            if language == "rust" and c == "'" and not re.match(r"'(\\.[^']*|[^'\\])'", text[i : i + 12]):
                i += 1  # a lifetime
                continue
            j = i + 1
            while j < n and text[j] != c and (text[j] != "\n" or c == "`"):
                j += 2 if text[j] == "\\" else 1
            blank(i + 1, j)
            i = j + 1
        else:
            i += 1
    return "".join(out)


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def block_end(masked: str, at: int) -> int:
    """Offset after the block that begins at the next `{`, or after the `;` or line that comes first."""
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
    return len(masked)


# ---- rules by language -------------------------------------------------------------------------

_ID = r"[A-Za-z_$][\w$]*"
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "else", "do", "sizeof", "match", "loop", "super", "await", "typeof", "throw", "fn", "func", "def", "class", "delete", "in", "of", "foreach", "echo", "using", "lock", "unless", "until", "elsif", "when", "defined", "and", "or", "not"}
_JS = [("function", rf"\bfunction\s*\*?\s*({_ID})\s*\("), ("class", rf"\bclass\s+({_ID})"), ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*({_ID})\s*\([^;{{}}]*\)\s*(?::[^{{;=]+)?\{{"), ("function", rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=]+)?=>")]
RULES: dict[str, list[tuple[str, str]]] = {
    "javascript": _JS,
    "typescript": [*_JS, ("interface", rf"\binterface\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("type", rf"\btype\s+({_ID})[^=;]*="), ("variable", rf"^(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=(?!\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=]+)?=>)")],
    "rust": [("function", rf"\bfn\s+({_ID})"), ("class", rf"\bstruct\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("interface", rf"\btrait\s+({_ID})"), ("module", rf"\bmod\s+({_ID})\s*\{{"), ("macro", rf"\bmacro_rules!\s*({_ID})")],
    "go": [("method", rf"\bfunc\s+\([^)]*\)\s*({_ID})"), ("function", rf"\bfunc\s+({_ID})"), ("type", rf"\btype\s+({_ID})\s")],
    "java": [("class", rf"\b(?:class|record)\s+({_ID})"), ("interface", rf"\binterface\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("method", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*[\w<>\[\],.? ]+\s+({_ID})\s*\([^;{{}}]*\)\s*(?:throws [\w, .]+)?\{{")],
    "csharp": [("class", rf"\b(?:class|record)\s+({_ID})"), ("interface", rf"\binterface\s+({_ID})"), ("struct", rf"\bstruct\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("method", rf"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\],.? ]+\s+({_ID})\s*\([^;{{}}]*\)\s*\{{")],
    "cpp": [("class", rf"\b(?:class|struct)\s+({_ID})\s*(?:final\s*)?(?::[^{{;]*)?\{{"), ("enum", rf"\benum\s+(?:class\s+)?({_ID})"), ("function", rf"^[ \t]*(?!(?:return|else|new|throw)\b)[\w:<>,*&~ \t]*?[\s*&]([A-Za-z_~]\w*(?:::~?\w+)*)\s*\([^;{{}}]*\)\s*(?:const\s*|noexcept\s*|override\s*)*(?::[^{{;]*)?\{{")],
    "php": [("class", rf"\b(?:class|trait)\s+({_ID})"), ("interface", rf"\binterface\s+({_ID})"), ("function", rf"\bfunction\s+&?({_ID})\s*\(")],
    "ruby": [("class", r"^[ \t]*class\s+([A-Z]\w*)"), ("module", r"^[ \t]*module\s+([A-Z]\w*)"), ("method", r"^[ \t]*def\s+(?:self\.)?([\w?!]+)")],
}
RULES["c"] = [("class", rf"\bstruct\s+({_ID})\s*\{{"), *RULES["cpp"][1:]]
_SCOPES = {"class", "struct", "interface", "module", "enum"}


def _ruby_end(text: str, at: int) -> int:
    indent = re.match(r"[ \t]*", text[text.rfind("\n", 0, at) + 1 :]).group(0)
    m = re.compile(rf"^{indent}end\b", re.M).search(text, at)
    return m.end() if m else len(text)


def symbols(text: str, language: str) -> list[Symbol]:
    """Definitions in the order of their lines, with the innermost enclosing scope."""
    if language == "python":
        out: list[Symbol] = []

        def visit(node, parent):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "function"
                    first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                    out.append(Symbol(child.name, kind, first, child.end_lineno or first, parent))
                    visit(child, child.name if kind == "class" else parent)
                else:
                    visit(child, parent)

        visit(ast.parse(text), None)
        return sorted(out, key=lambda s: (s.start, -s.end))
    if language not in RULES:
        raise ValueError(f"no rules for {language}")
    masked, at = mask(text, language), Lines(text)
    found: dict[int, tuple[str, str, int, int]] = {}
    for kind, rule in RULES[language]:
        for m in re.finditer(rule, masked, re.M):
            name = m.group(1)
            if name in _WORDS or m.start(1) in found:
                continue
            begin = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
            stop = _ruby_end(text, m.end()) if language == "ruby" else block_end(masked, m.end() - (m.group(0)[-1:] == "{"))
            found[m.start(1)] = (name, kind, begin, stop)
    spans = [(b, e, name) for name, kind, b, e in found.values() if kind in _SCOPES]
    if language == "rust":
        spans += [(m.start(), block_end(masked, m.end()), m.group(1)) for m in re.finditer(rf"\bimpl(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_ID})", masked)]
    out = []
    for name, kind, b, e in found.values():
        around = [s for s in spans if s[0] < b and e <= s[1] and s[2] != name] if language != "go" else []
        out.append(Symbol(name, kind, at.of(b), at.of(max(b, e - 1)), max(around, key=lambda s: s[0])[2] if around else None))
    return sorted(out, key=lambda s: (s.start, -s.end, s.name))


def _python_refs(text: str) -> list[Ref]:
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append(Ref("call", f.id, None, None, node.lineno))
            elif isinstance(f, ast.Attribute):
                out.append(Ref("call", f.attr, None, ast.unparse(f.value), node.lineno))
        elif isinstance(node, ast.Import):
            out += [Ref("import", a.name, a.asname, None, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            out += [Ref("import", f"{base}.{a.name}" if base.strip(".") else base + a.name, a.asname, None, node.lineno) for a in node.names]
    return out


def _rust_uses(body: str) -> list[tuple[str, str | None]]:
    """Paths and aliases of a `use`, groups expanded."""
    body = body.strip()
    m = re.match(r"(.*?)\{(.*)\}$", body, re.S)
    if m:
        parts, depth, last = [], 0, 0
        for i, c in enumerate(m.group(2)):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                parts.append(m.group(2)[last:i])
                last = i + 1
        parts.append(m.group(2)[last:])
        return [(re.sub(r"::self$", "", m.group(1).strip() + p), a) for x in parts if x.strip() for p, a in _rust_uses(x)]
    m = re.match(r"(.*?)\s+as\s+(\w+)$", body, re.S)
    return [(m.group(1), m.group(2))] if m else [(body, None)]


def references(text: str, language: str) -> list[Ref]:
    """Calls and imports with line, alias and context; empty for unknown languages."""
    if language == "python":
        return sorted(_python_refs(text), key=lambda r: (r.line, r.kind, r.name))
    if language not in RULES:
        return []
    masked, at, out = mask(text, language), Lines(text), []

    def add(kind, name, alias, context, offset):
        out.append(Ref(kind, name, alias, context, at.of(offset)))

    raw = lambda m, k: text[m.start(k) : m.end(k)]  # noqa: E731  names in quotes are masked
    if language in ("javascript", "typescript"):
        for m in re.finditer(r"^\s*import\s+(?:type\s+)?([^'\"]*?)\s*(?:from\s*)?(['\"])([^'\"]*)\2", masked, re.M):
            module = raw(m, 3)
            names = m.group(1).strip()
            for x in re.findall(rf"({_ID})(?:\s+as\s+({_ID}))?", (re.search(r"\{(.*?)\}", names, re.S) or [None, ""])[1]):
                add("import", f"{module}/{x[0]}", x[1] or None, None, m.start(3))
            lead = re.match(rf"(?:\*\s+as\s+)?({_ID})", names)
            if lead or not names:
                add("import", module, lead.group(1) if lead else None, None, m.start(3))
        for m in re.finditer(rf"\brequire\s*\(\s*(['\"])([^'\"]*)\1", masked):
            add("import", raw(m, 2), None, None, m.start())
    elif language == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", masked, re.M):
            add("import", m.group(1), None, None, m.start(1))
    elif language == "csharp":
        for m in re.finditer(rf"^\s*using\s+(?:static\s+)?(?:({_ID})\s*=\s*)?([\w.]+)\s*;", masked, re.M):
            add("import", m.group(2), m.group(1), None, m.start(2))
    elif language in ("c", "cpp"):
        for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*(<[^>\n]*>|\"[^\"\n]*\")", text, re.M):
            add("import", m.group(1), None, None, m.start(1))
    elif language == "go":
        for m in re.finditer(r"\bimport\s*(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"\n]*\"))", masked):
            k = 1 if m.group(1) is not None else 2
            for x in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]*)\"", raw(m, k)):
                add("import", x.group(2), x.group(1), None, m.start(k) + x.start(2))
    elif language == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", masked):
            for name, alias in _rust_uses(m.group(1)):
                add("import", name, alias, None, m.start(1))
    elif language == "php":
        for m in re.finditer(r"^\s*use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", masked, re.M):
            add("import", m.group(1), m.group(2), None, m.start(1))
    elif language == "ruby":
        for m in re.finditer(r"\brequire(?:_relative)?\s*\(?\s*(['\"])([^'\"]*)\1", masked):
            add("import", raw(m, 2), None, None, m.start(2))
    sep = r"(?:::|->|\?\.|\.)"
    defined = {m.start(1) for _, rule in RULES[language] for m in re.finditer(rule, masked, re.M)}
    for m in re.finditer(rf"((?:{_ID}\s*{sep}\s*)*)({_ID})(?:::<[^()]*>)?\s*\(", masked):
        name = m.group(2)
        if (name in _WORDS or language == "go" and name == "import") and not m.group(1) or m.start(1) in defined or m.start(2) in defined or re.search(r"\b(?:fn|func|function|def)\s+$", masked[max(0, m.start() - 12) : m.start()]):
            continue
        context = re.sub(rf"\s*{sep}\s*$", "", m.group(1)) or None
        add("call", name, None, re.sub(r"\s+", "", context) if context else None, m.start(2))
    return sorted(out, key=lambda r: (r.line, r.kind, r.name))


# ---- chunks ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chunk:
    text: str
    start: int
    end: int
    node_type: str
    scopes: tuple[str, ...]


def _size(text: str) -> int:
    return len(re.sub(r"\s", "", text))


def count_tokens(text: str) -> int:
    """An estimate: words by four letters, digits by three, every other sign by itself."""
    return sum(-(-len(w) // 4) if w[0].isalpha() else -(-len(w) // 3) if w[0].isdigit() else 1 for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", text))


def chunks(text: str, language: str, max_chars: int = 2000) -> list[Chunk]:
    """Definitions that fit are a chunk; larger ones are cut at their inner definitions, the rest in windows; small neighbours merge.

    Sizes count non-blank characters. The chunks' texts cover every non-blank line once, in order.
    """
    lines = text.splitlines(keepends=True)
    try:
        tree = symbols(text, language)
    except (SyntaxError, ValueError):
        tree = []
    pieces: list[Chunk] = []

    def windows(a: int, b: int, kind: str, scopes: tuple[str, ...]) -> None:
        held, size, first = [], 0, a
        for k in range(a, b + 1):
            line = lines[k - 1]
            if held and size + _size(line) > max_chars:
                pieces.append(Chunk("".join(held), first, k - 1, kind, scopes))
                held, size, first = [], 0, k
            while _size(line) > max_chars:  # one line alone is too large
                cut, n = 0, 0
                while n < max_chars:
                    n += not line[cut].isspace()
                    cut += 1
                pieces.append(Chunk(line[:cut], k, k, f"{kind}_part", scopes))
                line = line[cut:]
            held.append(line)
            size += _size(line)
        if held:
            pieces.append(Chunk("".join(held), first, b, kind, scopes))

    def walk(a: int, b: int, inner: list[Symbol], scopes: tuple[str, ...], kind: str) -> None:
        at = a
        for s in inner:
            if s.start < at or s.end > b:
                continue
            if s.start > at:
                windows(at, s.start - 1, kind, scopes)
            whole = "".join(lines[s.start - 1 : s.end])
            below = [x for x in inner if x is not s and s.start <= x.start and x.end <= s.end]
            name = (*scopes, f"{s.kind} {s.name}")
            if _size(whole) <= max_chars or not below:
                windows(s.start, s.end, s.kind, name)
            else:
                walk(s.start, s.end, below, name, s.kind)
            at = s.end + 1
        if at <= b:
            windows(at, b, kind, scopes)

    walk(1, len(lines), tree, (), "text")
    out: list[Chunk] = []
    for c in pieces:
        last = out[-1] if out else None
        if last and _size(last.text) + _size(c.text) <= max_chars and (last.scopes[:-1] == c.scopes[:-1] or not _size(c.text)):
            kind = last.node_type if last.node_type.endswith("_merged") else f"{last.node_type}_merged"
            out[-1] = Chunk(last.text + c.text, last.start, c.end, kind, last.scopes)
        else:
            out.append(c)
    return [c for c in out if _size(c.text)]


def definition_chunks(text: str, language: str) -> list[Chunk]:
    """Query mode: each definition is a chunk of its own, inner ones too; nothing is merged or cut."""
    lines = text.splitlines(keepends=True)
    return [Chunk("".join(lines[s.start - 1 : s.end]), s.start, s.end, s.kind, ()) for s in symbols(text, language)]


def limit_tokens(c: Chunk, max_tokens: int = 512, overlap: int = 50, strategy: str = "split") -> list[Chunk]:
    """The chunk itself, its first piece (`truncate`), or pieces that end at line, sentence or word ends and overlap."""
    if count_tokens(c.text) <= max_tokens:
        return [c]
    units = re.findall(r"[^\n.!?]*[\n.!?]+|[^\n.!?]+$", c.text)
    parts: list[str] = []
    for u in units:
        words = re.findall(r"\s*\S+\s*$|\s*\S+|\s+$", u) if count_tokens(u) > max_tokens else [u]
        for w in words:
            while count_tokens(w) > max_tokens:
                parts.append(w[:max_tokens])
                w = w[max_tokens:]
            parts.append(w)
    out, i = [], 0
    starts = [0]
    for x in parts:
        starts.append(starts[-1] + len(x))
    while i < len(parts):
        j, n = i, 0
        while j < len(parts) and (j == i or n + count_tokens(parts[j]) <= max_tokens):
            n += count_tokens(parts[j])
            j += 1
        piece = "".join(parts[i:j])
        first = c.start + c.text[: starts[i]].count("\n")
        out.append(Chunk(piece, first, first + piece.rstrip("\n").count("\n"), f"{c.node_type}_part", c.scopes))
        if strategy == "truncate" or j >= len(parts):
            return out
        back, n = j, 0
        while back > i + 1 and n + count_tokens(parts[back - 1]) <= overlap:
            back -= 1
            n += count_tokens(parts[back])
        i = back if back > i else j
    return out


def outline(found: list[Symbol]) -> str:
    """One line for each symbol, indented below its scope."""
    marks = {"class": "C", "interface": "I", "enum": "E", "module": "M", "type": "T", "function": "F", "method": "F"}
    return "\n".join(f"{'  ' if s.parent else ''}{marks.get(s.kind, 'V')}: {s.name} (L{s.start}-L{s.end})" for s in found)


def code_item(text: str, language: str, wanted: str) -> str | None:
    """The source of `name` or `Parent.name`."""
    parent, _, name = wanted.rpartition(".")
    for s in symbols(text, language):
        if s.name == name and (not parent or s.parent == parent):
            return "\n".join(text.splitlines()[s.start - 1 : s.end])
    return None


# ---- Spark -------------------------------------------------------------------------------------


def _apply(files: DataFrame, schema: str, names: list[str], rows_of, failed=None) -> DataFrame:
    """rows_of(path, language, content) of each file; of one that can't be parsed failed(path, error), or nothing."""
    fields = files.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            rows = []
            for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows += rows_of(path, language, content or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows += failed(path, e) if failed else []
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=shape)

    return files.select("path", "language", "content").mapInArrow(run, schema)


def extract_symbols(files: DataFrame) -> DataFrame:
    names = ["symbol_id", "name", "kind", "path", "start_line", "end_line", "parent_scope"]
    return _apply(files, SYMBOLS, names, lambda p, lang, t: [(f"{p}::{s.name}", s.name, s.kind, p, s.start, s.end, s.parent) for s in symbols(t, lang)]).dropDuplicates(["symbol_id"])


def extract_refs(files: DataFrame) -> DataFrame:
    names = ["path", "ref_kind", "name", "alias", "context", "line"]
    return _apply(files, REFS, names, lambda p, lang, t: [(p, r.kind, r.name, r.alias, r.context, r.line) for r in references(t, lang)])


def extract_errors(files: DataFrame) -> DataFrame:
    """path, error: files whose symbols can't be found, for want of rules or because they can't be parsed."""

    def check(p, lang, t):
        symbols(t, lang)
        return []

    return _apply(files, "path string, error string", ["path", "error"], check, lambda p, e: [(p, f"{type(e).__name__}: {e}")])


def extract_chunks(files: DataFrame, max_chars: int = 2000, max_tokens: int = 512, overlap: int = 50, strategy: str = "split", ast: bool = True) -> DataFrame:
    """Chunks by syntax, or with ast=False by definition."""
    names = ["chunk_id", "path", "content", "start_line", "end_line", "node_type", "scopes"]

    def rows(p, lang, t):
        out = []
        for c in chunks(t, lang, max_chars) if ast else definition_chunks(t, lang):
            pieces = limit_tokens(c, max_tokens, overlap, strategy)
            for i, x in enumerate(pieces):
                key = p + x.text + (str(i) if len(pieces) > 1 else "")
                out.append((hashlib.sha256(key.encode()).hexdigest()[:16], p, x.text, x.start, x.end, x.node_type, list(x.scopes)))
        return out

    return _apply(files, CHUNKS, names, rows)


def outlines(files: DataFrame) -> DataFrame:
    return _apply(files, "path string, outline string", ["path", "outline"], lambda p, lang, t: [(p, outline(symbols(t, lang)))])


def code_items(files: DataFrame, wanted: str) -> DataFrame:
    """path, code of `name` or `Parent.name` in the files that have it."""
    return _apply(files, "path string, code string", ["path", "code"], lambda p, lang, t: [(p, c) for c in [code_item(t, lang, wanted)] if c is not None])


def with_token_counts(df: DataFrame, content: str = "content") -> DataFrame:
    """df with `tokens`."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def count(texts):
        return texts.fillna("").map(count_tokens)

    return df.withColumn("tokens", count(F.col(content)))


def embed(texts, dim: int = 64):
    """Deterministic hashing vectors of unit length, one for each text; zeros only for texts without words.

    Where the words' signs cancel each other in every dimension, the words count without signs.
    """
    import numpy as np

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        at = []
        for w in re.findall(r"\w+", (t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            at.append(h % dim)
            out[i, h % dim] += 1 if h >> 63 else -1
        if at and not out[i].any():
            np.add.at(out[i], at, 1)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def with_embeddings(chunks_: DataFrame, dim: int = 64, embedder=embed, batch: int = 512) -> DataFrame:
    """chunks with `embedding`, made for at most `batch` texts at a time; null for texts whose vector is zero."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        given = list(texts)
        vs = [v for a in range(0, len(given), batch) for v in embedder(given[a : a + batch], dim)]
        return pd.Series([v.tolist() if v.any() else None for v in vs])

    return chunks_.withColumn("embedding", run(F.col("content")))
