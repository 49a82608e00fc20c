"""Functions paired with their documentation.

Method: source texts are parsed by an error-recovering generalised LL grammar on a graph-structured stack (``gll``), which yields the functions
of whole and of broken files alike, each with its header, its documentation as the file has it, and whether its own block is valid. Nodes of kind Function
and Method say which documentation holds: the valid row of an id is the one delivered last. Where the parser found a valid function and its documentation
says what the valid row says, the file's text is judged, with its marks, lines and sections, and what is the function's own name and parameters comes from the
parsed header as well as from the signature; else, and beyond the kept head of a file, the row's text is judged. A documentation is reduced
to what it says by itself (``telling_words``). Whole descriptions, with own words and numbers masked, are counted by hash over all documented functions,
and those that TEMPLATE_SHARE of them have in common are dropped as templates.

Defined results: a null or blank doc says nothing; a node without id, or of another kind, is none. Of rows delivered at the same
time the greater (doc, signature) is valid. A function that lies beyond the kept head of its file, or whose file was not kept, keeps its
pair with a null code. Repeated rows give one pair. Texts and docs of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.normalize import clean_id, clean_kind, clean_path
from graphloom.llm.gll import parse
from graphloom.session import stored

#: Content words that a documentation needs.
LEAST_WORDS = 3
#: A masked description that at least this share of all documented functions has in common is a template.
TEMPLATE_SHARE = 0.02
#: Documented functions without any template that every corpus is thought to have besides its own, so that a share of few functions says little.
TEMPLATE_PRIOR = 1000
#: Characters of a file that are kept; a text of that length was cut off.
KEPT = 4000

# Words without content of their own, in English, German, French and Spanish.
_STOP = frozenset(
    """a an the this that these those of to in on for and or is are be was were been with by from at as it its not no if else than then so do does did has have had can will into between while until
    der die das den dem des ein eine einen einem einer eines und oder ist sind wird werden von zu zum zur im in mit auf an als es sich nicht bei aus
    le la les un une des du de et ou est sont en dans par pour sur au aux avec ne pas qui que se son sa
    el los las una unos y o es son del al con por para su sus lo que se no""".split()
)
# Words that say no more than that there is a function with parameters and a result.
_GENERIC = frozenset("function method returns return returned result results value values given gets get set sets funktion methode gibt zurück fonction méthode renvoie retourne función método devuelve retorna resultado any none null void self cls type".split())
# What people write where documentation should be, as words of a whole sentence.
_PLACEHOLDER = re.compile(
    r"(?:(?:todo|fixme|tbd|xxx+|hack|wip)\b.*|(?:auto ?generated|missing|empty|no|add|write|insert|sample|dummy|default)(?: a| the| some| your)? (?:doc ?string|documentation|description|docs?|comment|summary)(?: (?:here|yet|available|provided|needed))*"
    r"|(?:documentation|description|docstring|docs?|summary|comment|text) (?:goes|comes|is|to be|will be|should go)\b.{0,30}|(?:doc ?string|documentation|description|summary|comment|placeholder|platzhalter|beschreibung|dokumentation|descripción|marcador)"
    r"|por hacer|pendiente|à compléter|à faire|à documenter|noch zu .{0,25}|folgt(?: noch)?|sin documentar|sin documentación|sans documentation|undokumentiert|undocumented|not documented|to be (?:documented|done|written|defined)"
    r"|lorem ipsum.*|n a|na|none|nothing|pass|self explanatory|work in progress|coming soon)"
)
_POINTER = re.compile(
    r"(?:(?:please )?(?:see|cf|siehe|vgl|voir|véase|ver)(?: also)?\b(?: \S+){0,3} (?:base|parent|super|above|below|class|interface|method|oben|unten|basisklasse|oberklasse|ci dessus|arriba|abajo|clase base|classe de base|classe mère)"
    r"|siehe oben|see above|voir (?:plus haut|ci dessus)|véase arriba|same as (?:above|base|parent|super)\b.{0,20}|(?:documentation |docs |doc )?inherit(?:s|ed|doc| doc)?(?: (?:from|by|doc|docs|documentation)\b.{0,40})?"
    r"|geerbt(?: von.{0,30})?|hérité(?:e)?(?: de.{0,30})?|heredad[oa](?: de.{0,30})?|overrides?(?: \S+){0,3}|implements(?: \S+){0,2})"
)
_TOOL = re.compile(
    r"^(?:noqa\b|type:\s*ignore|pylint|flake8|ruff|mypy:|pyright|isort:|fmt:\s*(?:on|off|skip)|black:|nosec\b|pragma\b|coverage:|eslint|tslint|jshint|jscs|prettier-|stylelint|istanbul|c8 ignore|v8 ignore|@?ts-(?:ignore|nocheck|expect)|nolint|noinspection|sonar|spell-?check|cspell|#?(?:end)?region\b|globals? |-\*-|vim:"
    r"|\{?@(?:internal|override|private|public|protected|readonly|static|async|ignore|hidden|api|inheritdoc|inherit|suppress\w*|nocollapse|constructor|abstract|final|virtual|export|package|function|method|memberof\s+\S+|name\s+\S+|todo)\b)",
    re.I,
)
_BYLINE = re.compile(
    r"^@?(?:authors?|autor(?:en|es|a)?|auteurs?|verfasser|copyright|copr\.|©|\(c\)|licen[cs]ed?|spdx\S*|version|since|seit|depuis|desde|created|erstellt|créé|creado|date|datum|fecha|modified|changed|last (?:changed|modified)|maintainers?|revision|history|ticket|issue|jira|bug)\b\s*(?::|\(|©|by\b|von\b|par\b|por\b|on\b|am\b|le\b|el\b|<|\d|@|=|-|$|[A-Z])",
    re.I,
)
_RELEASE = re.compile(r"^(?:version\s+|rev(?:ision)?\.?\s+)?v?\d+(?:\.\d+)+(?:[-+.]\w+)?\.?$", re.I)
_TICKET = re.compile(r"\b[A-Z][A-Z0-9]{1,9}-\d+\b|(?<!\w)#\d+\b|\bgh-\d+\b")
_TICKET_WORDS = frozenset("see siehe voir véase ver cf ref refs fixes fixed fix closes closed resolves resolved ticket issue bug jira for für pour para related to part of".split())
_TODO = re.compile(r"(?:^|(?<=[\s(]))(?:TODO|FIXME|XXX|HACK|WIP)\b(?:\([^)]*\))?:?[^\n.!?]*(?:[.!?]+(?=\s|$)|$)", re.M)
_FIELD = re.compile(r"^(?:[@:\\])(param(?:eter)?|arg(?:ument)?|keyword|key|type|rtype|returns?|yields?|throws|exception|raises?|prop(?:erty)?|template|typeparam|tparam|var|ivar|cvar)\b:?\s*(.*)$", re.I | re.S)
_SECTION = re.compile(r"^(?:args?|arguments?|param(?:eter)?s?|other parameters|keyword args|returns?|return value|yields?|raises?|throws|exceptions?|attributes|argumente|rückgabe(?:wert)?|paramètres|retour|retourne|parámetros|devuelve|retorna)\s*:?$", re.I)
_CODE_SECTION = re.compile(r"^(?:examples?|usage|beispiele?|exemples?|ejemplos?)\s*:*$", re.I)
_ENTRY = re.compile(r"^[-*]?\s*(\*{0,2}[^\W\d]\w*(?:\s*,\s*\w+)*)\s*(?:\([^)]*\))?\s*(?::|–|—|-(?=\s))\s*(.*)$", re.S)
_CODE = re.compile(
    r"^(?:>>>.*|\.\.\. .*|return\s+[\w.$]+(?:\(.*\))?;?|(?:import|from)\s+[\w.]+(?:\s+import\s+.+)?|(?:def|class|function|const|let|var|if|for|while|export|async)\b.*[:{;=)]$|[\w.$]+(?:\[[^\]]*\])?\s*[-+*/]?=(?!=)\s*\S.*|(?:await\s+)?[\w.$]+\([^)]*\);?|[{}()\[\];,]+)$"
)
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ0-9])(?=[A-ZÀ-Þ])|(?<=[A-Z])(?=[A-Z][a-z])")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n\s*\n")
_QUOTES = re.compile(r'^\s*(?:[rbuf]{0,2}(?:"""|\'\'\')|/\*+!?|<!--)|(?:"""|\'\'\'|\*+/|-->)\s*$', re.I)
_LINE_MARK = re.compile(r"^[ \t]*(?:///?!?|\*(?![\w*])|#+(?!region)|--(?=\s)|;;)[ \t]?", re.M)
_RULE = re.compile(r"^[\s\-=*_~.#+?!…/\\|<>]*$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _stem(w: str) -> str:
    """A rough stem: without an inflection, then without a last vowel (verify, verifies, verifys: verif)."""
    for e in ("ies", "ing", "es", "ed", "s"):
        if w.endswith(e) and len(w) - len(e) >= 3:
            w = w[: -len(e)]
            break
    return w[:-1] if w[-1] in "eyi" and len(w) > 3 else w


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", text))]


def _content(words: list[str]) -> list[str]:
    out = []
    for w in words:
        if _CJK.search(w):
            out += list(w)
        elif w not in _STOP and (len(w) > 1 or not w.isascii()):
            out.append(w)
    return out


def _lines(doc: str) -> list[tuple[str, bool]]:
    """What stays of the doc, line by line: (text, whether it describes a parameter or result)."""
    text = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    for _ in range(3):
        shorter = _QUOTES.sub("", text).strip()
        if shorter == text:
            break
        text = shorter
    text = _TODO.sub("", re.sub(r"```.*?(?:```|\Z)", "", _LINE_MARK.sub("", text), flags=re.S))
    out: list[tuple[str, bool]] = []
    section = code = False
    for line in text.split("\n"):
        x = line.strip().strip("`").strip("\"'").strip()
        if not x:
            code = False
            if section and not line[:1].isspace():
                section = False
            out.append(("", False))
            continue
        if _RULE.match(x):
            continue
        if _CODE_SECTION.match(x):
            code = True
            continue
        if x.startswith(">>>"):
            code = True
        if code or _TOOL.match(x) or _BYLINE.match(x) or _RELEASE.match(x) or _CODE.match(x):
            continue
        if _SECTION.match(x):
            section = True
            continue
        if _TICKET.search(x) and not [w for w in _words(_TICKET.sub(" ", x)) if w not in _TICKET_WORDS]:
            continue
        if x[0] in "@:\\" and (m := _FIELD.match(x)):
            rest = re.sub(r"^\{[^}]*\}\s*", "", m[2])
            if m[1].lower() in ("type", "rtype"):
                continue
            if not m[1].lower().startswith(("return", "yield")):
                rest = re.sub(r"^(?:\[?[\w.$*]+(?:=[^\]]*)?\]?)?\s*(?:\w+\s*(?=:))?[-–—:]*\s*", "", rest)
            out.append((rest.strip(" -–—:"), True))
            continue
        if x[0] in "@{" and (m := re.match(r"^\{?@(\w+)\s*(.*?)\}?$", x)):
            out.append((m[2], False))
            continue
        if section and (m := _ENTRY.match(x)):
            out.append((m[2], True))
            continue
        out.append((x, section))
    return out


def telling_words(doc: str | None, own: str) -> tuple[int, str, str]:
    """(content words left, description, masked description) of a doc; own: the function's signature and name.

    Taken away are marks, placeholders, notes to tools, pointers to inherited docs, bylines, bare code, parameters and results without a
    description of their own, and sentences that say nothing beyond the function's own words.
    """
    if not doc or not doc.strip():
        return 0, "", ""
    mine = {_stem(w) for w in _words(own)} | _GENERIC
    kept, count, masked = [], 0, []
    pieces: list[tuple[str, bool]] = []
    for text, field in _lines(doc):
        # A paragraph may run over several lines; a field is a piece of its own.
        if text and pieces and not field and pieces[-1][0] and not pieces[-1][1] and not pieces[-1][0].endswith((".", "!", "?")):
            pieces[-1] = (f"{pieces[-1][0]} {text}", False)
        else:
            pieces.append((text, field))
    for text, _ in pieces:
        for sentence in _SENTENCE.split(text):
            words = _words(sentence)
            if not words:
                continue
            flat = " ".join(words)
            if _PLACEHOLDER.fullmatch(flat) or _POINTER.fullmatch(flat):
                continue
            content = _content(words)
            if not [w for w in content if w not in mine and _stem(w) not in mine]:
                continue
            count += len(content)
            kept.append(sentence.strip())
            masked.append(" ".join("\0" if _stem(w) in mine else "0" if w.isdigit() else w for w in words))
    return count, " ".join(kept), re.sub(r"\0(?: \0)*", "\0", " ".join(masked))


def valid_functions(nodes: DataFrame) -> DataFrame:
    """The valid row of each Function and Method: one per id, that delivered last."""
    rows = nodes.filter(clean_kind("kind").isin("FUNCTION", "METHOD")).select(
        clean_id("id").alias("node_id"), "repo_id", clean_path("path").alias("path"), "start_line", "qname", "signature", "doc", "loaded_at"
    )
    latest = Window.partitionBy("node_id").orderBy(*[F.col(c).desc_nulls_last() for c in ("loaded_at", "doc", "signature", "qname", "path", "start_line", "repo_id")])
    return rows.filter("node_id is not null").withColumn("r", F.row_number().over(latest)).filter("r = 1").drop("r", "loaded_at")


def described(functions: DataFrame) -> DataFrame:
    """The functions with n_words, description and template of their documentation; null-safe in every column. See the module's docstring for which text is judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for doc, text, sig, qname, header, whole in zip(*[b.column(c).to_pylist() for c in ("doc", "doc_text", "signature", "qname", "header", "whole")]):
                said = " ".join(_words(doc or ""))
                if whole and text and said and said in " ".join(_words(text)):
                    doc = text
                told.append(telling_words(doc, f"{sig or ''} {(qname or '').rsplit('.', 1)[-1]} {header or ''}"))
            more = [pa.array([t[0] for t in told], pa.int32()), pa.array([t[1] for t in told], pa.string()), pa.array([t[2] for t in told], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "n_words", "description", "template"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in functions.schema.fields)
    return functions.mapInArrow(run, f"{schema}, n_words int, description string, template string")


def without_templates(told: DataFrame, share: float = TEMPLATE_SHARE) -> DataFrame:
    """Drops descriptions whose template recurs all over the corpus. At most 1/share hashes can, so their set is broadcast.

    Counted over all documented functions, those that say nothing included. share above 1 keeps everything.
    """
    counts = told.filter("template <> ''").groupBy("template").agg(F.count("*").alias("n"))
    total = told.agg(F.count("*").alias("total")).scalar()
    frequent = counts.filter(F.col("n") >= share * (total + TEMPLATE_PRIOR)).select("template")
    return told.join(F.broadcast(frequent), "template", "left_anti").drop("template")


def parsed_functions(texts: DataFrame, kept: int = KEPT) -> DataFrame:
    """(repo_id, path, start_line, name, header, doc_text, code, whole): the functions of each source text; header is the part of the code up to its parameters' end."""
    source = r"(?i)\.(pyi?|pyx|[cm]?jsx?|[cm]?tsx?|java|kt|go|rs|c|h|cc|cpp|hpp|cs|php|swift|scala|dart)$"
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
    names = ["repo_id", "path", "start_line", "name", "header", "doc_text", "code", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, path, head in zip(*[c.to_pylist() for c in b.columns]):
                lines = None
                for f in parse(head, path, len(head) < kept):
                    lines = lines or head.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    code = "\n".join(lines[f.start - 1 : f.end])
                    doc = "\n".join(lines[f.doc[0] - 1 : f.doc[1]]) if f.doc[0] else None
                    rows.append((repo, path, f.start, f.name, code[: code.find(")") + 1], doc, code, f.valid))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    heads = texts.select("repo_id", clean_path("path").alias("path"), "head").filter("head is not null and path is not null").filter(F.col("path").rlike(source))
    return heads.mapInArrow(run, "repo_id string, path string, start_line int, name string, header string, doc_text string, code string, whole boolean")


def documented_pairs(nodes: DataFrame, texts: DataFrame, with_code: bool = True, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(node_id, repo_id, path, qname, signature, description[, code, whole]), one row per documented function. See the module's docstring.

    The functions of the corpus are parsed once and joined with the valid nodes by file and first line; what is told is written once, since it is
    needed for the templates' counts and for the result.
    """
    documented = valid_functions(nodes).filter(F.length(F.trim("doc")) >= 3).withColumn("name", F.substring_index("qname", ".", -1))
    cols = ["header", "doc_text", "whole", *(["code"] if with_code else [])]
    key = ["repo_id", "path", "start_line", "name"]
    # A file may come in several copies: the greatest row of a place is one function, not a mix of several.
    code = parsed_functions(texts).groupBy(*key).agg(F.max(F.struct("whole", *[c for c in cols if c != "whole"])).alias("f")).select(*key, *[f"f.{c}" for c in cols])
    out = ["node_id", "repo_id", "path", "qname", "signature", "description", *(["code", "whole"] if with_code else [])]
    judged = described(documented.join(code, key, "left")).select(*out, "n_words", F.xxhash64("template").alias("hash"), "template")
    told = stored(judged.withColumn("template", F.when(F.col("template") != "", F.col("hash").cast("string")).otherwise("")).drop("hash"), "told")
    return without_templates(told, share).filter(F.col("n_words") >= LEAST_WORDS).select(*out)
