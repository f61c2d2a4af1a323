"""Structure of source files: imports, exports, symbols, main functions; Arrow batches of files through a small scanner.

TypeScript, JavaScript and the script parts of Vue, Svelte and Astro files are scanned with comments, strings and nested
blocks masked, so that only top-level declarations count (confidence high). Other languages get one set of patterns
(medium), all else an empty row (low). A file that the scanner fails on is treated as of no known language.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte", ".astro")
HEURISTIC = (".cjs", ".cs", ".cts", ".go", ".java", ".mjs", ".mts", ".php", ".py", ".rb")
MAIN_FUNCTIONS = 8
SYMBOL = "array<struct<name: string, kind: string, line: int, exported: boolean, is_async: boolean>>"
ANALYSES = f"project_id string, path string, analyzer string, confidence string, imports array<string>, exports array<string>, symbols {SYMBOL}, top_functions {SYMBOL}"

NAME = r"[A-Za-z_$][\w$]*"
DECLARATION = re.compile(
    r"(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?P<async>async\s+)?function\s*\*?\s*(?P<function>" + NAME + r")?"
    r"|class\s+(?P<class>" + NAME + r")|interface\s+(?P<interface>" + NAME + r")|type\s+(?P<type>" + NAME + r")\s*[=<]|(?:const\s+)?enum\s+(?P<enum>" + NAME + r")"
    r"|const(?P<const>\s+(?=[\w$])|\s*(?=[{\[]))|(?:let|var)(?P<other>\s+(?=[\w$])|\s*(?=[{\[])))"
)
METHOD = re.compile(r"(?:^|[;}\n])\s*(?:(?:public|private|protected|static|override|readonly)\s+)*(?P<async>async\s+)?\*?(?P<name>" + NAME + r")\s*(?:<[^>]*>)?\(")
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "new", "await", "super"}
# Patterns for languages without a scanner.
ANY_IMPORT = re.compile(r"""(?:import\s+(?:[^'"]+\s+from\s+)?|export\s+[^'"]+\s+from\s+|require\()\s*['"]([^'"]+)['"]""")
ANY_SYMBOL = [
    ("function", re.compile(r"(?P<export>export\s+)?(?P<async>async\s+)?function\s+(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)")),
    ("const", re.compile(r"(?P<export>export\s+)?const\s+(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?P<async>async\s*)?")),
    ("class", re.compile(r"(?P<export>export\s+)?class\s+(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)")),
    ("interface", re.compile(r"(?P<export>export\s+)?interface\s+(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)")),
    ("type", re.compile(r"(?P<export>export\s+)?type\s+(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)")),
    ("enum", re.compile(r"(?P<export>export\s+)?enum\s+(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)")),
]
SPECIFIERS = [
    re.compile(r"""(?<![\w$.])import\s*(?:type\s+)?(?:[\w$*{}\s,]+?\s*from\s*)?['"]([^'"]+)['"]"""),
    re.compile(r"""(?<![\w$.])export\s*(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['"]([^'"]+)['"]"""),
    re.compile(r"""(?<![\w$.])require\(\s*['"]([^'"]+)['"]\s*\)"""),
]
FUNCTIONS = ("function", "const", "class", "method")
MASKED = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[(,=:\[!&|?{};\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*""", re.DOTALL)


def masked(text: str, keep_quotes: bool = False) -> str:
    """Comments and strings as blanks of the same length; line breaks, and if kept the quotes of strings, stay."""

    def blank(m: re.Match) -> str:
        gap = re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + gap[1:-1] + m[0][-1] if keep_quotes and m[0][0] in "\"'" else gap

    return MASKED.sub(blank, text)


class Nesting:
    """How deep in braces, brackets and parentheses a place is, from the places where that changes."""

    def __init__(self, code: str) -> None:
        self.at, self.depth, depth = [], [0], 0
        for m in re.finditer(r"[(){}\[\]]", code):
            opens = m[0] in "({["
            depth += 1 if opens else -1
            # a bracket lies outside what it encloses
            self.at.append(m.end() if opens else m.start())
            self.depth.append(depth)

    def __getitem__(self, place: int) -> int:
        return self.depth[bisect_right(self.at, place)]


def bound_names(code: str, nesting: Nesting, at: int) -> Iterator[tuple[int, str]]:
    """Places and names that a declaration binds whose first name or pattern begins at ``at``."""
    outer = nesting[at]
    while m := re.compile(r"\s*(?:(" + NAME + r")|[{\[])").match(code, at):
        if m[1]:
            yield m.start(1), m[1]
            at = m.end()
        else:
            opened = m.end() - 1
            at = opened + 1
            while at < len(code) and nesting[at] > outer:
                at += 1
            # in a pattern, what stands before a comma, a default or the end is bound, but not a key before its colon
            for name in re.finditer(r"(" + NAME + r")\s*(?=[,}\]]|=(?!>))", code[opened:at + 1]):
                if not re.search(r"=\s*$", code[opened : opened + name.start()]):
                    yield opened + name.start(1), name[1]
            at += 1
        # on to a comma of this declaration
        while at < len(code) and not (nesting[at] == outer and code[at] in ",;"):
            if nesting[at] < outer or nesting[at] == outer and code[at] == "\n" and re.match(r"\s*[\w$@]", code[at:]) and not re.search(r"[,=+\-*/&|?:<>.]\s*$", code[max(0, at - 80) : at]):
                return
            at += 1
        if at >= len(code) or code[at] == ";":
            return
        at += 1


def script_at(path: str, content: str) -> tuple[str, int] | None:
    """The script part of a component file, or the text of any other, and where it begins; None if there is none."""
    if path.endswith((".vue", ".svelte")):
        blocks = [(m[1] or "", m[2], m.start(2)) for m in re.finditer(r"<script(\s[^>]*)?\s*>(.*?)</script>", content, re.DOTALL | re.IGNORECASE)]
        if path.endswith(".svelte"):
            blocks.sort(key=lambda b: bool(re.search(r"context\s*=\s*[\"']module", b[0])))
        return blocks[0][1:] if blocks and blocks[0][1].strip() else None
    if path.endswith(".astro"):
        front = re.match(r"---\r?\n(.*?)\r?\n---", content, re.DOTALL)
        return (front[1], front.start(1)) if front and front[1].strip() else None
    return content, 0


def script_of(path: str, content: str) -> str | None:
    """The script part of a component file, the text of any other; None if there is none."""
    found = script_at(path, content)
    return found and found[0]


def scan_script(text: str) -> tuple[list[str], list[str], list[dict]]:
    """Imports in order, exported names sorted, top-level symbols in order."""
    # keywords count outside strings only; what stands between quotes comes from the text itself
    code, quoted = masked(text), masked(text, keep_quotes=True)
    nesting = Nesting(code)
    imports = [text[m.start(1) : m.end(1)] for p in SPECIFIERS for m in p.finditer(quoted)]
    exports, symbols = set(), []
    for m in re.finditer(r"(?<![\w$.])export\s*(?:type\s*)?\{([^}]*)\}", code):
        exports |= {part.split(" as ")[-1].strip().removeprefix("type ").strip() for part in m[1].split(",") if part.strip()}
    if re.search(r"(?<![\w$.])export\s+default\b", code):
        exports.add("default")
    for m in DECLARATION.finditer(code):
        if nesting[m.start()] or (m.start() and re.match(r"[\w$.]", code[m.start() - 1])):
            continue
        kind = m.lastgroup if m.lastgroup not in ("export", "default", "async") else None
        kind = next((k for k in ("function", "class", "interface", "type", "enum", "const", "other") if m[k]), kind)
        if not kind:
            continue
        exported = bool(m["export"])
        if kind in ("const", "other"):
            bound = list(bound_names(code, nesting, m.end()))
            if exported:
                exports |= {name for _, name in bound}
            for at, name in bound if kind == "const" else []:
                is_async = bool(re.match(r"[^=;\n]*=\s*async\b", code[at + len(name) :]))
                symbols.append({"name": name, "kind": kind, "line": text.count("\n", 0, at) + 1, "exported": exported, "is_async": is_async})
            continue
        name, is_async = m[kind], bool(m["async"])
        if exported and not m["default"]:
            exports.add(name)
        symbols.append({"name": name, "kind": kind, "line": text.count("\n", 0, m.start()) + 1, "exported": exported, "is_async": is_async})
        if kind == "class" and (opening := code.find("{", m.end())) >= 0:
            inner = nesting[opening] + 1
            for method in METHOD.finditer(code, opening + 1):
                at = method.start("name")
                if nesting[at] < inner:
                    break
                if nesting[at] == inner and method["name"] not in KEYWORDS:
                    symbols.append({"name": method["name"], "kind": "method", "line": text.count("\n", 0, at) + 1, "exported": False, "is_async": bool(method["async"])})
    return list(dict.fromkeys(imports)), sorted(exports), symbols


def scan_any(text: str) -> tuple[list[str], list[str], list[dict]]:
    found: dict[str, dict] = {}
    for kind, pattern in ANY_SYMBOL:
        for m in pattern.finditer(text):
            symbol = {"name": m["name"], "kind": kind, "line": text.count("\n", 0, m.start()) + 1, "exported": bool(m["export"]), "is_async": bool(m.groupdict().get("async"))}
            if m["name"] not in found or symbol["exported"] > found[m["name"]]["exported"]:
                found[m["name"]] = symbol
    symbols = sorted(found.values(), key=lambda s: (s["line"], s["name"]))
    return list(dict.fromkeys(ANY_IMPORT.findall(text))), sorted(s["name"] for s in symbols if s["exported"]), symbols


def analyse_one(path: str, extension: str, content: str, remap_lines: bool = False) -> tuple:
    lines = 0
    try:
        if extension in SCRIPT:
            script = script_at(path.lower(), content)
            if script is None:
                return "script", "medium", [], [], [], []
            lines = content.count("\n", 0, script[1]) if remap_lines else 0
            found, analyzer, confidence = scan_script(script[0]), "script", "high"
        elif extension in HEURISTIC:
            found, analyzer, confidence = scan_any(content), "heuristic", "medium"
        else:
            return "fallback", "low", [], [], [], []
    except (ValueError, IndexError, re.error, RecursionError):
        return "fallback", "low", [], [], [], []
    imports, exports, symbols = found
    symbols = [s | {"line": s["line"] + lines} for s in symbols] if lines else symbols
    main = sorted((s for s in symbols if s["kind"] in FUNCTIONS), key=lambda s: (not s["exported"], s["line"], s["name"]))[:MAIN_FUNCTIONS]
    return analyzer, confidence, imports, exports, symbols, main


def analyse(files: DataFrame, remap_lines: bool = False) -> DataFrame:
    """files(project_id, path, extension, content) to a row of ANALYSES for each.

    Lines of symbols count from the start of the script block; from that of the file if remap_lines.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.project_id, r.path, *analyse_one(r.path, r.extension or "", r.content or "", remap_lines)) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["project_id", "path", "analyzer", "confidence", "imports", "exports", "symbols", "top_functions"])

    return files.select("project_id", "path", "extension", "content").mapInPandas(run, ANALYSES)
