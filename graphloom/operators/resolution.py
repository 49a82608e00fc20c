"""Resolution of names across files: imports to files, calls to definitions; ambiguous means unresolved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.model import DEFINITIONS
from graphloom.session import stored


def suffixes(c: Column, sep: str) -> Column:
    """All suffixes of a separated name, the name itself included: a.b.c, b.c, c."""
    parts = F.split(c, F.lit("\\" + sep if sep == "." else sep))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))


#: Kinds of edges that are resolved, with the kinds of definitions that they prefer.
PREFER = {"CALLS": DEFINITIONS, "EXTENDS": ("CLASS",)}
#: Suffixes of script sources, in the order in which they are tried.
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def import_bindings(nodes: DataFrame) -> DataFrame:
    """(repo_id, path, module, name, alias) of the import lists that File nodes carry; without an alias, the imported name stands for it, of a default import the module."""
    files = nodes.filter("kind = 'FILE' and extra is not null").select("repo_id", "path", F.explode("extra.imports").alias("i"))
    rows = files.select("repo_id", "path", "i.module", "i.name", "i.alias").filter("module is not null or name is not null")
    return rows.withColumn("alias", F.coalesce(F.nullif("alias", F.lit("")), F.nullif(F.nullif("name", F.lit("")), F.lit("default")), F.col("module"))).distinct()


def normal_path(c: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; what leads out of the root keeps its ``..`` in front."""
    parts = F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))
    step = lambda done, x: F.when((x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, x))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _python_files(module: Column, folder: Column) -> Column:
    """Paths, without suffix, that a Python module means: relative ones go up a folder for each dot but the first."""
    level = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.array_join(F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda x: x != ""), "/")
    ups = level - 1
    base = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - ups)), "/")
    whole = F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(rest, F.lit("")))
    return F.when(level == 0, F.nullif(rest, F.lit(""))).when(ups <= F.size(folder), whole)


def module_candidates(bindings: DataFrame) -> DataFrame:
    """(repo_id, path, module, name, said, candidate, priority, absolute): files that a binding may mean, in order; the submodule before the module itself.

    Python importers try ``x.py`` and ``x/__init__.py``, relative or absolute. Scripts only know relative modules: the path as it is, a TypeScript source in place
    of a script, each suffix of SCRIPTS, and index files. said: the module, or the submodule, that led to the candidate.
    """
    own = ["repo_id", "path", "module", "name"]
    module = F.trim("module")
    named = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("*"))
    sub = F.when(~named.isin("*", "default"), F.concat(module, F.when(module.endswith("."), F.lit("")).otherwise(F.lit(".")), named))
    said = F.filter(F.array(F.struct(F.lit(0).alias("at"), sub.alias("said")), F.struct(F.lit(50).alias("at"), module.alias("said"))), lambda x: F.coalesce(x["said"] != "", F.lit(False)))
    folder = F.filter(F.split(F.regexp_replace("path", r"[^/]*$", ""), "/"), lambda x: x != "")
    rows = bindings.filter(F.length(module) > 0).select(*own, folder.alias("folder"), F.explode(said).alias("s")).select(*own, "folder", "s.*")
    python = F.lower("path").endswith(".py")
    relative = F.col("said").startswith(".")
    rows = rows.withColumn("stem", F.when(python, _python_files(F.col("said"), F.col("folder"))))
    rows = rows.withColumn("target", F.when(F.lower("path").rlike(r"\.([cm]?js|jsx|tsx?)$") & relative, normal_path(F.concat_ws("/", F.array_join("folder", "/"), F.col("said")))))
    rows = rows.withColumn("source", F.when(F.col("target").rlike(r"\.(js|mjs|cjs)$"), F.regexp_replace("target", r"\.[^./]*$", "")))
    # Columns of their own, so that no path is worked out once for each of its candidates.
    ends = ["", *SCRIPTS, *[f"/index{x}" for x in SCRIPTS]]
    tried = F.array(*[F.struct(F.lit(k if not x else k + 2).alias("k"), F.concat("target", F.lit(x)).alias("candidate")) for k, x in enumerate(ends)], *[F.struct(F.lit(k).alias("k"), F.concat("source", F.lit(x)).alias("candidate")) for k, x in ((1, ".ts"), (2, ".tsx"))])
    lead = F.when(F.col("stem") == "", F.array(F.struct(F.lit(0).alias("k"), F.lit("__init__.py").alias("candidate")))).when(
        F.col("stem").isNotNull(), F.array(*[F.struct(F.lit(k).alias("k"), F.concat("stem", F.lit(x)).alias("candidate")) for k, x in enumerate((".py", "/__init__.py"))])
    ).when(~F.col("target").startswith(".."), tried)
    out = rows.select(*own, "said", "at", (python & ~relative).alias("absolute"), F.explode(lead).alias("c")).filter("c.candidate is not null")
    return out.select(*own, "said", "c.candidate", (F.col("at") + F.col("c.k")).alias("priority"), "absolute")


def resolve_imports(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, module, name, target, how, said): the file each binding means, or none.

    exact: a candidate path is a file of the repo. suffix: for an absolute module, exactly one file ends with a candidate. Self-imports are dropped.
    """
    return module_files(bindings, files).filter(F.col("target") != F.col("path"))


def module_files(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """As ``resolve_imports``, with a file's imports of itself."""
    key = ["repo_id", "path", "module", "name"]
    f = files.select("repo_id", F.col("path").alias("target")).distinct()
    c = module_candidates(bindings)
    exact = c.join(f.select("repo_id", "target", F.col("target").alias("candidate")), ["repo_id", "candidate"]).withColumn("how", F.lit("exact"))
    ends = f.select("repo_id", "target", F.explode(suffixes(F.col("target"), "/")).alias("candidate")).filter("candidate <> target")
    one = ends.groupBy("repo_id", "candidate").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1")
    suffix = c.filter("absolute").join(one.select("repo_id", "candidate", "target"), ["repo_id", "candidate"]).withColumn("how", F.lit("suffix"))
    pick = exact.select(*key, "said", "priority", "target", "how").unionByName(suffix.select(*key, "said", (F.col("priority") + 20).alias("priority"), "target", "how"))
    best = pick.groupBy(*key).agg(F.min(F.struct("priority", "target", "how", "said")).alias("b"))
    return best.select(*key, "b.target", "b.how", "b.said")


def unique_names(nodes: DataFrame, prefer: tuple[str, ...] = ("FUNCTION", "CLASS"), keys: tuple[str, ...] = ("repo_id", "name")) -> DataFrame:
    """(repo_id, name, id): simple names that exactly one function or class has; if those are none, exactly one definition."""
    d = nodes.filter(F.col("kind").isin(*DEFINITIONS) & F.col("name").isNotNull())
    top = F.col("kind").isin(*prefer)
    g = d.groupBy(*keys).agg(F.count_if(top).alias("n_top"), F.count("*").alias("n_all"), F.min(F.when(top, F.col("id"))).alias("top_id"), F.min("id").alias("any_id"))
    pick = F.when(F.col("n_top") == 1, F.col("top_id")).when((F.col("n_top") == 0) & (F.col("n_all") == 1), F.col("any_id"))
    return g.select(*keys, pick.alias("id")).filter("id is not null")


def _preferred(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``unique_names`` for each kind of edge that is resolved."""
    each = [unique_names(nodes, prefer, keys).withColumn("kind", F.lit(kind)) for kind, prefer in PREFER.items()]
    return reduce(DataFrame.unionByName, each)


def through_imports(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls with target: the definition that an import of the caller's file leads to. calls: (kind, repo_id, src, detail, path).

    The longest dotted prefix that is an alias and leads anywhere decides, by one definition or not at all; then star imports, for names of one part.
    """
    b = import_bindings(nodes).filter("module is not null").withColumn("name", F.nullif("name", F.lit("")))
    joined = F.concat("module", F.when(F.col("module").endswith("."), F.lit("")).otherwise(F.lit(".")), "name")
    none = F.lit(None).cast("string").alias("name")
    modules = b.select("repo_id", "path", "module", none).unionByName(b.filter("name is not null").select("repo_id", "path", joined.alias("module"), none)).distinct()
    files = nodes.filter("kind = 'FILE'").select("repo_id", "path").distinct()
    at = module_files(modules, files).select("repo_id", "path", F.col("module").alias("m"), F.col("target").alias("file"))
    picked = _preferred(nodes, ("repo_id", "path", "name")).select("kind", "repo_id", F.col("path").alias("file"), F.col("name").alias("symbol"), F.col("id").alias("target"))
    key = ["kind", "repo_id", "src", "detail", "path"]
    parts = calls.withColumn("parts", F.split("detail", r"\."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("parts", F.lit(1), i), ".").alias("alias"), F.get("parts", i).alias("rest")))
    named = parts.select(*key, F.explode(prefixes).alias("p")).select(*key, "p.i", "p.alias", "p.rest").join(b.filter("coalesce(name, '') <> '*'"), ["repo_id", "path", "alias"])
    stars = parts.filter(F.size("parts") == 1).select(*key, F.lit(0).alias("i"), F.col("detail").alias("alias"), none.alias("rest")).join(b.filter("name = '*'").drop("alias"), ["repo_id", "path"])
    look = lambda k, m, symbol: F.struct(F.lit(k).alias("k"), m.alias("m"), symbol.alias("symbol"))
    module, rest, alias = F.col("module"), F.col("rest"), F.col("alias")
    looks = (
        F.when(F.col("name").isNull(), F.array(look(0, module, rest)))
        .when(F.col("name").isin("default", "*"), F.array(look(0, module, F.coalesce(rest, alias))))
        .when(rest.isNotNull(), F.array(look(0, joined, rest), look(1, module, rest)))
        .otherwise(F.array(look(0, module, F.col("name"))))
    )
    each = named.unionByName(stars).select(*key, "i", "module", "name", F.explode(looks).alias("l")).select(*key, "i", "module", "name", "l.*")
    found = each.join(at, ["repo_id", "path", "m"]).join(picked, ["kind", "repo_id", "file", "symbol"])
    per_binding = found.groupBy(*key, "i", "module", "name").agg(F.min_by("target", "k").alias("target"))
    per_prefix = per_binding.groupBy(*key, "i").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    best = per_prefix.groupBy(*key).agg(F.max(F.struct("i", "n", "target")).alias("b"))
    return best.filter("b.n = 1").select(*key, "b.target")


def _resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ext = nodes.filter("kind = 'EXTERNALSYMBOL'").select(F.col("id").alias("dst"), F.col("name").alias("target_name"))
    caller = nodes.filter(F.col("kind").isin(*DEFINITIONS)).select(F.col("id").alias("src"), F.col("kind").alias("caller_kind"), "path", F.regexp_extract("qname", r"^(.*)\.[^.]*$", 1).alias("scope"))
    said = edges.filter(F.col("kind").isin(*PREFER)).select("kind", "repo_id", "owner_path", "src", "dst", "detail").join(ext, "dst")
    said = said.withColumn("detail", F.coalesce(F.nullif(F.trim("detail"), F.lit("")), F.nullif(F.trim("target_name"), F.lit("")))).filter("detail is not null")
    calls = stored(said.select("kind", "repo_id", "owner_path", "src", "detail").distinct().join(caller, "src"), "unresolved")
    bound = F.col("detail").rlike(r"^(self|cls|this)(\.|$)")
    d = nodes.filter(F.col("kind").isin(*DEFINITIONS) & F.col("qname").isNotNull()).select("repo_id", "id", "qname", F.col("kind").alias("what"), "path")
    names = d.select("repo_id", F.col("qname").alias("detail"), "id")
    key = ["kind", "repo_id", "owner_path", "src", "detail"]
    cols = [*key, "target", "rule"]
    exact = calls.join(names.groupBy("repo_id", "detail").agg(F.max("id").alias("target")), ["repo_id", "detail"]).withColumn("rule", F.lit(1))
    ends = d.select("repo_id", "id", F.explode(suffixes(F.col("qname"), ".")).alias("detail")).groupBy("repo_id", "detail").agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1").drop("n")
    free = calls.filter(~bound)
    via = free.withColumn("path", F.coalesce("owner_path", "path")).select(*key, "path")
    imported = through_imports(via.drop("owner_path").distinct(), nodes).join(via, ["kind", "repo_id", "src", "detail", "path"]).withColumn("rule", F.lit(5))
    suffix = free.filter(F.contains("detail", F.lit("."))).join(ends, ["repo_id", "detail"]).withColumn("rule", F.lit(3))
    simple = free.withColumn("name", F.substring_index("detail", ".", -1)).join(_preferred(nodes, ("repo_id", "name")).withColumnRenamed("id", "target"), ["kind", "repo_id", "name"]).withColumn("rule", F.lit(4))
    every = exact.select(*cols).unionByName(imported.select(*cols)).unionByName(suffix.select(*cols)).unionByName(simple.select(*cols))
    method = d.filter("what = 'METHOD'").select("repo_id", "path", F.col("qname").alias("q"), "id").groupBy("repo_id", "path", "q").agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1")
    own = calls.filter((F.col("kind") == "CALLS") & (F.col("caller_kind") == "METHOD") & (F.col("scope") != "") & bound & (F.size(F.split("detail", r"\.")) == 2)).withColumn("q", F.concat_ws(".", "scope", F.substring_index("detail", ".", -1)))
    every = every.unionByName(own.join(method.drop("n"), ["repo_id", "path", "q"]).withColumn("rule", F.lit(2)).select(*cols))
    order = F.when(F.col("rule") == 5, 2.5).otherwise(F.col("rule").cast("double")).alias("order")
    best = every.groupBy(*key).agg(F.min(F.struct(order, "rule", "target")).alias("b")).select(*key, "b.target", "b.rule")
    return best.filter(F.col("target") != F.col("src"))


def _once(nodes: DataFrame) -> DataFrame:
    """What resolution needs of the nodes, written once: its joins read them many times."""
    return stored(nodes.filter(F.col("kind").isin("FILE", "EXTERNALSYMBOL", *DEFINITIONS)).select("id", "repo_id", "kind", "name", "qname", "path", "extra"), "resolvable")


def resolve_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, src, detail, target, rule): definitions that calls to, and classes extending, external symbols really mean.

    Rules, in order: 1 the dotted name is a qualified name; 2 ``self.``, ``cls.`` or ``this.`` in a method, and a method of its class in the same file; 5 an import of the
    caller's file leads to it; 3 exactly one qualified name ends with the dotted name; 4 the last part is a unique simple name. Names of rule 2 take no later rule. A
    missing detail is the symbol's name. Bases of classes have no rule 2 and prefer classes. References to oneself are dropped.
    """
    return _resolved(edges, _once(nodes)).select("repo_id", "src", "detail", "target", "rule").distinct()


def import_edges(nodes: DataFrame) -> DataFrame:
    """Edges from files to the files that they import, with the module or submodule as detail; one for each detail."""
    files = nodes.filter("kind = 'FILE'")
    at = files.groupBy("repo_id", "path").agg(F.min("id").alias("id"))
    found = resolve_imports(import_bindings(nodes), files).select("repo_id", "path", "target", F.col("said").alias("detail")).distinct()
    both = found.join(at.withColumnRenamed("id", "src"), ["repo_id", "path"]).join(at.select("repo_id", F.col("path").alias("target"), F.col("id").alias("dst")), ["repo_id", "target"])
    return both.select("repo_id", F.col("path").alias("owner_path"), "src", "dst", F.lit("IMPORTS").alias("kind"), "detail")


def resolve_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with all ``resolved`` ones built anew: imports between files, calls and bases that mean a definition. An edge that is there already stays as it is."""
    key = ["repo_id", "owner_path", "src", "dst", "kind", "detail"]
    nodes = _once(nodes)
    kept = stored(edges.filter(~F.coalesce(F.lower("confidence") == "resolved", F.lit(False))).select(*key, "confidence"), "kept-edges")
    calls = _resolved(kept, nodes).select("repo_id", "owner_path", "src", F.col("target").alias("dst"), "kind", "detail")
    new = import_edges(nodes).unionByName(calls).dropDuplicates(key)
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    new = new.alias("n").join(kept.select(*key).distinct().alias("k"), same, "left_anti")
    return kept.select(*key, "confidence").unionByName(new.withColumn("confidence", F.lit("resolved")))


def enclosing(nodes: DataFrame, bucket: int = 64) -> DataFrame:
    """(id, owner): for each function, method or class the narrowest other definition of its file whose lines hold its first line.

    A range join by buckets of lines: a definition is listed under each bucket that it spans, and meets only lines of those buckets.
    """
    d = nodes.filter(F.col("kind").isin(*DEFINITIONS)).select("repo_id", "path", "id", "start_line", "end_line")
    wide = d.select("repo_id", "path", F.col("id").alias("owner"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("b"))
    inner = d.select("repo_id", "path", "id", "start_line", F.floor(F.col("start_line") / bucket).alias("b"))
    hit = inner.join(wide, ["repo_id", "path", "b"]).filter("owner <> id and start_line between s and e and not (s = start_line and owner > id)")
    return hit.groupBy("id").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("span"), F.col("s").alias("s"), F.col("owner").alias("owner"))).alias("m")).select("id", "m.owner", "m.span")
