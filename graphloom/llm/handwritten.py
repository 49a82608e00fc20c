"""Source files nobody wrote by hand: generated, locked, minified, vendored, or data in the place of code.

Method: each file's head is lexed (comments, strings, numbers, words, brackets, separators) and printed again in a canonical layout: one statement a
line, one level of indent for each open block, bracketed lists joined to one line (``printed``). The original is compared with that print:

* extreme expansion - many printed lines for each line there was, and long lines - marks minified files;
* perfect uniformity - the original agrees with the print line by line, and nearly all of its lines have one shape of tokens - marks generated ones;
* literal dominance - nearly all of the text lies in strings and numbers - marks data blobs.

The shares are shrunk by a prior (PRIOR_CHARS, PRIOR_LINES), so that little text needs more dominance than much; there is no least size.
Layout cannot tell a generator's output from hand-written code where both are formatted alike, nor a vendored copy from its source. For these, notices in the
leading comments, as the lexer finds them, and whole parts of the path count as evidence: a file that mentions them in code, in a doc or in a later
comment is hand-written, as is one below ``vendor_portal/``. ``evidence=False`` leaves layout alone to decide. Prose and settings can only be lock
files or data. The generated flag and the size are hints that decide nothing.

Defined results: a file without a head is judged by its path; an empty head and a null path are hand-written; a file that
occurs several times, in several spellings or with several heads, gives one row (the first class in order of CLASSES).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.normalize import clean_path

CLASSES = ["lock", "vendored", "generated", "minified", "data"]

# Names under which tools and package managers leave files.
_LOCKS = {
    "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "uv.lock", "pdm.lock", "pipfile.lock", "cargo.lock",
    "gemfile.lock", "composer.lock", "go.sum", "bun.lock", "bun.lockb", "packages.lock.json", "flake.lock", "mix.lock", "pubspec.lock", "podfile.lock",
    "gradle.lockfile", "deno.lock", "conda-lock.yml", "package.resolved",
}
_VENDOR_DIRS = {
    "vendor", "_vendor", "vendored", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "extern", "external",
    "externals", "deps", "node_modules", "bower_components", "site-packages", "dist-packages", "jspm_packages", "godeps", "pods", "carthage",
}
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|[._](?:generated|gen|g|designer|autogen)\.[a-z]+|\.pb(?:\.gw)?\.(?:go|cc|h)|_rc\.py|\.freezed\.dart|zz_generated[._a-z]*\.go)$", re.I)
_MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|chunk|prod)\.(?:m?js|cjs|css)$", re.I)
_PROSE = re.compile(r"\.(?:md|mdx|markdown|rst|txt|adoc)$", re.I)
_SETTINGS = re.compile(r"\.(?:json5?|jsonc|ya?ml|toml|ini|cfg|conf|properties|xml)$", re.I)
_HASH_COMMENTS = re.compile(r"\.(?:pyi?|rb|sh|bash|pl|r|ya?ml|toml|cfg|conf|mk|cmake)$", re.I)

# What generators write into the first comment, in several languages.
_NOTICE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b|\bautomatically generated\b|\bmachine[- ](?:written|generated)\b|\bgenerated (?:by|from|file|code|using|with)\b"
    r"|\bdo not (?:edit|modify|touch|change)\b|\bdon'?t (?:edit|modify|touch)\b|\bemitted by\b|\bproduced (?:by|from)\b|\bcompiled from\b|\b(?:changes|edits) (?:will|would) be (?:lost|overwritten)\b"
    r"|\bautomatisch (?:erzeugt|erstellt|generiert)\b|\bnicht (?:bearbeiten|ändern|editieren)\b|\bautomatiquement\b|\bne pas (?:modifier|éditer)\b|\bgénérée? par\b"
    r"|\bgenerado\b|\bautomáticamente\b|\bno (?:modificar|editar)\b",
    re.I,
)
_TALK = re.compile(r"\b(?:never|always|should|must|skips?|ignores?|checks?|detects?|say|says|marked|banners?|whether|unless|if)\b", re.I)
_RELEASE = re.compile(r"\bv?\d+\.\d+(?:\.\d+)?\b")
_ORIGIN = re.compile(r"@license\b|\bupstream\b|\bdistribution\b|\blocal copy\b|\bvendored\b|\blicen[cs]ed? (?:under|mit|bsd)|\b(?:mit|bsd|apache|gpl|isc|mpl)\b|\(c\)|©|\bcopied from\b|^/\*!", re.I)

_STRING = r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|`(?:[^`\\]|\\.)*`?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
#: Group 1: comments and docstrings, which are prose about code; else a string.
_LEX = {
    True: re.compile(r"(#[^\n]*|(?<=\n)[ \t]*(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)))|" + _STRING, re.S),
    False: re.compile(r"(/\*.*?(?:\*/|\Z)|//[^\n]*)|" + _STRING, re.S),
}
_NUMBERS = re.compile(r"\b\d[\w.]*")
_LEAD = {
    True: re.compile(r"\A\ufeff?(?:[ \t]*(?:#[^\n]*)?(?:\n|\Z))*"),
    False: re.compile(r"\A\ufeff?(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.S),
}
_WORDS = re.compile(r"[^\W\d]\w*")
_SPLIT = re.compile(r"([;{}()\[\]\n])")

#: Printed lines per line, and characters per line, from which a file is minified.
EXPANSION, LONG_LINE = 6.0, 200.0
#: Share of the characters in literals from which a file is a data blob.
LITERALS = 0.75
#: Share of lines that agree with the print, and of lines of one shape, from which a file is generated.
AGREEMENT, UNIFORM = 0.99, 0.9
#: Characters of code and lines of other shapes that every file is thought to have besides its own.
PRIOR_CHARS, PRIOR_LINES = 100, 3


def lexed(head: str, hashes: bool) -> tuple[str, int]:
    """(code without comments and with ``0`` for each string, characters in strings) of a text."""
    text = "\n" + head.replace("\r\n", "\n").replace("\r", "\n")
    strings = 0

    def literal(m: re.Match) -> str:
        nonlocal strings
        if m[1] is not None:
            return ""
        strings += m.end() - m.start()
        return "0"

    return _LEX[hashes].sub(literal, text), strings


def printed(code: str, hashes: bool) -> list[tuple[int, str]]:
    """The canonical layout of lexed code: (level of indent, statement without spaces), one a line.

    Braced code: a statement ends at ``;``, at a brace or at a line end outside of brackets; a brace that closes takes along what follows up to the statement's end.
    Indented code: a statement ends at ``;`` or at a line end outside of brackets; its level is that of its indent.
    """
    out: list[tuple[int, str]] = []
    level = depth = 0
    indents, part, first = [0], [], True

    def put() -> None:
        text = "".join("".join(part).split())
        part.clear()
        if text:
            out.append((level, text))

    for x in _SPLIT.split(code):
        if not x:
            continue
        if hashes and first and depth == 0 and not x.isspace():
            column = len(x) - len(x.lstrip()) if x not in ";{}()[]" else 0
            while indents[-1] > column:
                indents.pop()
            if column > indents[-1]:
                indents.append(column)
            level, first = len(indents) - 1, False
        if x == "\n":
            if depth == 0:
                put()
                first = True
        elif x in "([" or (hashes and x == "{"):
            depth += 1
            part.append(x)
        elif x in ")]" or (hashes and x == "}"):
            depth = max(0, depth - 1)
            part.append(x)
        elif x == ";":
            part.append(x)
            if depth == 0:
                put()
        elif x == "{":
            part.append(x)
            put()
            level += 1
            indents.append(depth)
            depth = 0
        elif x == "}":
            put()
            level = max(0, level - 1)
            depth = indents.pop() if len(indents) > 1 else 0
            part.append(x)
        else:
            part.append(x)
    put()
    return out


def layout(head: str, hashes: bool) -> tuple[float, float, float, float, float]:
    """(expansion, characters a line, literal share, agreement, uniformity) of a text against its canonical layout."""
    code, strings = lexed(head, hashes)
    lines = [x for x in code.split("\n") if x and not x.isspace()]
    if not lines:
        return 0.0, 0.0, strings / (strings + PRIOR_CHARS), 0.0, 0.0
    canonical = printed(code, hashes)
    columns = [len(x) - len(x.lstrip()) for x in lines]
    unit = min((c for c in columns if c), default=1)
    there = Counter((c / unit, "".join(x.split())) for c, x in zip(columns, lines))
    same = sum(min(n, there.get(x, 0)) for x, n in Counter(canonical).items())
    numbers = sum(map(len, _NUMBERS.findall(code)))
    rest = max(0, len(code) - code.count(" ") - code.count("\n") - code.count(",") - numbers)
    shapes = Counter(_WORDS.sub("w", _NUMBERS.sub("0", "\n".join([x for _, x in canonical]))).split("\n"))
    return (
        len(canonical) / len(lines), len(head) / (head.count("\n") + 1), (strings + numbers) / (strings + numbers + rest + PRIOR_CHARS),
        same / max(len(lines), len(canonical)), max(shapes.values()) / (len(canonical) + PRIOR_LINES),
    )


def notices(lead: str) -> tuple[bool, bool]:
    """(generated, vendored) by the leading comments of a file."""
    generated = any(_NOTICE.search(x) and not (_TALK.search(x) and "do not" not in x.lower()) and not re.search(r"\b(?:never|banners?)\b", x, re.I) for x in lead.split("\n"))
    vendored = bool(_RELEASE.search(lead) and _ORIGIN.search(lead)) or bool(re.search(r"\bupstream\b.*\b(?:copy|https?:)", lead, re.I | re.S))
    return generated, vendored and not generated


def classify(path: str | None, head: str | None, evidence: bool = True) -> str | None:
    """The class of a file, or null for a hand-written one. path is in its compared form. evidence: whether notices and names of code files count."""
    if not path:
        return None
    *dirs, name = path.split("/")
    low = name.lower()
    if low in _LOCKS or low.endswith((".lock", ".lockb")):
        return "lock"
    if evidence and any(x.lower() in _VENDOR_DIRS for x in dirs):
        return "vendored"
    if _PROSE.search(low):
        return None
    settings, hashes = bool(_SETTINGS.search(low)), bool(_HASH_COMMENTS.search(low))
    found, lead = None, ""
    if head and head.strip():
        expansion, per_line, literals, agreement, uniform = layout(head, hashes)
        lead = _LEAD[hashes].match(head)[0]
        if literals >= LITERALS and (not settings or per_line >= LONG_LINE):
            found = "data"  # settings are all names and values; only a blob among them is data
        elif not settings and expansion >= EXPANSION and per_line >= LONG_LINE:
            found = "minified"
        elif not settings and agreement >= AGREEMENT and uniform >= UNIFORM:
            found = "generated"
    if settings and head and head[:40].lstrip().startswith('{"lockfileVersion"'):
        return "lock"
    generated, vendored = notices(lead) if evidence and lead.strip() else (False, False)
    if generated or (evidence and not settings and _GENERATED_NAME.search(low)):
        return "generated"
    if evidence and not settings and _MINIFIED_NAME.search(low):
        return "minified"
    return "vendored" if vendored and not settings else found


def classify_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo_id, path, file_class): each file that nobody wrote by hand, once, with its path in compared form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [classify(p, h) for p, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([CLASSES.index(x) if x else None for x in found], pa.int32())], names=["repo_id", "path", "rank"])

    schema = "repo_id string, path string, rank int"
    heads = texts.select("repo_id", clean_path("path").alias("path"), "head").filter("path is not null")
    # By path alone, for files of which no text was kept; one row per file before Python sees them.
    known = files.select("repo_id", clean_path("path").alias("path")).filter("path is not null").distinct().withColumn("head", F.lit(None).cast("string"))
    both = heads.mapInArrow(run, schema).unionByName(known.mapInArrow(run, schema))
    best = both.groupBy("repo_id", "path").agg(F.min("rank").alias("rank")).filter("rank is not null")
    return best.select("repo_id", "path", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("rank") + 1).alias("file_class"))
