"""Full-text search over nodes: postings, BM25, and tiers that are gated by counts per query - all queries in one plan."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.model import EXTERNAL
from graphloom.operators.symbols import substring_hits
from graphloom.session import stored

#: Searched columns.
FIELDS = ("qname", "name", "signature", "doc", "path")
K1, B = 1.2, 0.75
#: Queries of at most so many words are answered from the sets of their words; so many sets are looked for at a time.
SET_WORDS, BLOCK_SETS = 4, 200_000
#: Letters that are a plain letter with marks, and those plain letters.
_FOLDS = {chr(i): d[0] for i in range(0xC0, 0xAC00) if unicodedata.category(chr(i))[0] == "L" and len(d := unicodedata.normalize("NFD", chr(i))) > 1 and all(unicodedata.category(x)[0] == "M" for x in d[1:])}
_PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def terms(c: Column | str) -> Column:
    """The words of a text: runs of letters or digits of any script, in lower case and without marks (``_`` separates). An accented letter counts as its plain one."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))
    folded = F.transform(words, lambda w: F.when(w.rlike("^[a-z0-9]+$"), w).otherwise(F.regexp_replace(F.translate(w, *_PLAIN), r"\p{M}+", "")))
    return F.filter(folded, lambda w: w != "")


def query_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit("[A-Za-z0-9_./:-]+"), F.lit(0))


def postings(nodes: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, term, tf): how often each field of a searchable node holds each word."""
    return _words(nodes, fields).groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def _words(nodes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    kept = nodes.filter(~F.coalesce(F.col("kind").isin(*EXTERNAL), F.lit(False)))
    parts = F.array(*[F.struct(F.lit(f).alias("field"), terms(F.coalesce(f, F.lit(""))).alias("words")) for f in fields])
    return kept.select("id", F.explode(parts).alias("p")).select("id", "p.field", F.explode("p.words").alias("term"))


def index(nodes: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The words of each field, written once to the shared folder: a search reads them several times. A word that a field holds twice has two rows of 1, so that nothing is shuffled."""
    return stored(_words(nodes, fields).withColumn("tf", F.lit(1)), "postings")


def by_node(nodes: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, dl, words): each searchable node that has words, how many they are, and each of them with how often it occurs, in order; written once.

    Words are counted inside the node's own row, so nothing is shuffled for lengths and counts.
    """
    kept = nodes.filter(~F.coalesce(F.col("kind").isin(*EXTERNAL), F.lit(False)))
    rows = kept.select("id", F.array_sort(F.flatten(F.array(*[terms(F.coalesce(f, F.lit(""))) for f in fields]))).alias("held"))
    placed = F.transform("held", lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    rows = rows.select("id", F.size("held").alias("dl"), F.filter(placed, lambda x: (x["at"] == 0) | (x["term"] != F.get("held", x["at"] - 1))).alias("firsts"))
    counts = F.transform("firsts", lambda x, k: F.struct(x["term"].alias("term"), (F.coalesce(F.get("firsts", k + 1)["at"], F.col("dl")) - x["at"]).alias("tf")))
    return stored(rows.select("id", "dl", counts.alias("words")), "node-words").filter("dl > 0")


def corpus_stats(posts: DataFrame) -> DataFrame:
    """(n_docs, n_tokens, avg_len) of the searchable nodes that have words at all."""
    return posts.agg(F.countDistinct("id").alias("n_docs"), F.sum("tf").alias("n_tokens")).withColumn("avg_len", F.col("n_tokens") / F.col("n_docs"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, n_terms) of queries (qid, query): distinct words."""
    words = queries.select("qid", F.array_distinct(terms("query")).alias("words"))
    return words.select("qid", F.size("words").alias("n_terms"), F.explode("words").alias("term"))


def bm25(posts: DataFrame, queries: DataFrame, every: bool, limit: int | None = None) -> DataFrame:
    """(qid, id, n_hit, score): nodes that hold every (or any) word of a query; less is better, as in SQLite's FTS5. posts: those of ``postings``, ``index`` or ``by_node``.

    Sums run over all searched columns, counts over the whole corpus. A word in more than half of the nodes counts next to nothing. With a limit, the nodes
    of the ``limit`` best scores of each query, of equal ones those with the least ids.
    """
    q = stored(query_terms(queries), "query-words")
    grouped = "words" in posts.columns
    worth = _worth(posts, q) if grouped else _worth_of_postings(posts, q)
    if every:
        return _with_every_word(stored(worth, "worth"), q, limit)
    if limit is None:
        return _with_any_word(worth, q)
    worth = worth if grouped else stored(worth, "worth")
    out = _best_by_sets(_held(worth), q.filter(F.col("n_terms") <= SET_WORDS), limit)
    long = q.filter(F.col("n_terms") > SET_WORDS)
    return out if long.isEmpty() else out.unionByName(first_per_query(_with_any_word(worth, long), [F.col("score"), F.col("id")], limit))


def _gain(n: Column, avg: Column) -> Column:
    """What a word adds to a node; the same for all queries, so it is worked out once, before queries meet it."""
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg))


def _worth(nodes: DataFrame, q: DataFrame) -> DataFrame:
    """(id, term, df, gain) of the words that queries ask for. nodes: those of ``by_node``. Only counts for each word are shuffled, unless queries ask for more words than a block of sets."""
    each = nodes.select("id", "dl", F.explode("words").alias("w")).select("id", "dl", "w.term", "w.tf")
    df = stored(each.groupBy("term").agg(F.count("*").alias("df")).join(q.select("term").distinct(), "term", "left_semi"), "known-words")
    n, avg = nodes.agg(F.count("*").alias("n")).scalar(), nodes.agg((F.sum("dl") / F.count("*")).alias("a")).scalar()
    return each.join(F.broadcast(df) if df.count() <= BLOCK_SETS else df, "term").select("id", "term", "df", _gain(n, avg).alias("gain"))


def _worth_of_postings(posts: DataFrame, q: DataFrame) -> DataFrame:
    doc_len = posts.groupBy("id").agg(F.sum("tf").alias("dl"))
    tf = posts.join(q.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, avg = doc_len.agg(F.count("*").alias("n")).scalar(), doc_len.agg((F.sum("dl") / F.count("*")).alias("a")).scalar()
    return tf.join(df, "term").join(doc_len, "id").select("id", "term", "df", _gain(n, avg).alias("gain"))


def _with_any_word(worth: DataFrame, q: DataFrame) -> DataFrame:
    return worth.join(q, "term").groupBy("qid", "id").agg(F.count("*").alias("n_hit"), F.round(-F.sum("gain"), 6).alias("score"))


def _held(worth: DataFrame) -> DataFrame:
    """(id, held): each node with those of its own words that queries ask for, in order."""
    return stored(worth.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "gain"))).alias("held")), "held")


def _key(words: Column) -> Column:
    """Words in order as one text, each after a blank."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w)), "")


def _holders(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, n, score): the nodes that hold all words of a wanted set, n words, and what these add up to. wanted: (key), distinct, and with each key its prefixes.

    A node's sets grow word by word, and only while they begin a wanted one. Wanted sets are broadcast in blocks of about BLOCK_SETS, so a node never leaves its task;
    a block goes by the first word, which keeps prefixes together, so one word's sets are the least that a block can hold.
    """
    blocks = -(-wanted.count() // BLOCK_SETS)
    first = F.split_part(F.ltrim("key"), F.lit(" "), F.lit(1))
    found = []
    for k in range(max(1, blocks)):
        asked = F.broadcast(wanted if blocks < 2 else wanted.filter(F.pmod(F.xxhash64(first), F.lit(blocks)) == k))
        level = held.select("id", F.lit("").alias("key"), F.lit(0.0).alias("sum"), F.col("held").alias("rest"))
        for n in range(1, SET_WORDS + 1):
            level = level.select("id", "key", "sum", "rest", F.posexplode("rest").alias("i", "h"))
            level = level.select("id", F.concat("key", F.lit(" "), "h.term").alias("key"), (F.col("sum") + F.col("h.gain")).alias("sum"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest")).join(asked, "key")
            found.append(level.select("key", "id", F.lit(n).cast("long").alias("n"), F.round(-F.col("sum"), 6).alias("score")))
    return reduce(DataFrame.unionByName, found)


def _first_of_sets(holders: DataFrame, limit: int) -> DataFrame:
    return holders.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("score", "id"))).filter(F.col("_r") <= limit)


def _best_by_sets(held: DataFrame, q: DataFrame, limit: int) -> DataFrame:
    """(qid, id, n_hit, score, position): the best nodes that hold any word of a query, without a pair for every word and node.

    A node among the best of a query is also among the ``limit`` best holders of the set of words that it shares with the query: whatever comes before it there holds
    these words too, so it scores no worse in the query. So each set of words that is part of a query is cut to its best holders, inside the tasks first, before queries meet it: exact, and
    work grows with the nodes and the queries, not with their product. A set with ``limit`` holders also says which score a query's best can't be worse than.
    """
    subsets = lambda words: F.aggregate(words, F.array(F.lit("")), lambda done, w: F.concat(done, F.transform(done, lambda s: F.concat(s, F.lit(" "), w))))
    sets = stored(q.groupBy("qid").agg(F.array_sort(F.collect_list("term")).alias("words")).select("qid", F.explode(subsets(F.col("words"))).alias("key")).filter("key <> ''"), "query-sets")
    best = stored(_first_of_sets(_holders(held, stored(sets.select("key").distinct(), "wanted-sets")), limit), "set-hits")
    full = best.filter(F.col("_r") == limit).select("key", F.col("score").alias("last"))
    bound = sets.join(full, "key").groupBy("qid").agg(F.min("last").alias("bound"))
    hits = sets.join(bound, "qid", "left").join(best, "key").filter(F.col("bound").isNull() | (F.col("score") <= F.col("bound")))
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    whole = hits.select("qid", "id", "n", "score").repartition(parts, "qid").groupBy("qid", "id").agg(F.max("n").alias("n_hit"), F.min("score").alias("score"))
    return first_per_query(whole, [F.col("score"), F.col("id")], limit)


def _with_every_word(worth: DataFrame, q: DataFrame, limit: int | None) -> DataFrame:
    """(qid, id, n_hit, score[, position]): nodes that hold all words of a query, found by the set of its words; of more than SET_WORDS words by the rarest, the others being looked up after."""
    known = q.join(worth.groupBy("term").agg(F.max("df").alias("df")), "term")
    rare = known.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("df", "term"))).withColumn("_n", F.count("*").over(Window.partitionBy("qid"))).filter(F.col("_n") == F.col("n_terms")).filter(F.col("_r") <= SET_WORDS)
    asked = stored(rare.groupBy("qid").agg(F.first("n_terms").alias("n_terms"), F.array_sort(F.collect_list("term")).alias("words")), "asked-sets")
    starts = asked.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: _key(F.slice("words", F.lit(1), i)))).alias("key"))
    holders = _holders(_held(worth), stored(starts.distinct(), "wanted-sets"))
    asked = asked.withColumn("key", _key(F.col("words"))).drop("words")
    short, long = asked.filter(F.col("n_terms") <= SET_WORDS), asked.filter(F.col("n_terms") > SET_WORDS)
    own = holders.join(short.select("key").distinct(), "key", "left_semi")
    hits = (own if limit is None else _first_of_sets(own, limit)).join(short, "key")
    out = hits.select("qid", "id", F.col("n").alias("n_hit"), "score")
    if not long.isEmpty():
        more = holders.join(long, "key").select("qid", "id", "n_terms").join(q.select("qid", "term"), "qid").join(worth, ["id", "term"])
        more = more.groupBy("qid", "id").agg(F.count("*").alias("n_hit"), F.round(-F.sum("gain"), 6).alias("score"), F.max("n_terms").alias("n_terms")).filter("n_hit = n_terms").drop("n_terms")
        out = out.unionByName(more)
    return out if limit is None else first_per_query(out, [F.col("score"), F.col("id")], limit)


def first_per_query(hits: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("position") <= limit)


def any_field(posts: DataFrame, queries: DataFrame, fields: tuple[str, ...], limit: int) -> DataFrame:
    """(qid, id, position): the first nodes, by id, that hold any word of the query in one of the fields; unranked tiers.

    A query's first ``limit`` nodes are among the first ``limit`` of each of its words, so words are cut to those before queries meet them: exact,
    and the join makes at most limit pairs for each word of a query. A hot word is cut inside the tasks, before it is shuffled.
    """
    held = posts.filter(F.col("field").isin(*fields)).select("term", "id").distinct()
    first = held.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy("id"))).filter(F.col("_r") <= limit).drop("_r")
    return first_per_query(first.join(query_terms(queries), "term").select("qid", "id").distinct(), [F.col("id")], limit)


TIERS = ("path", "column", "strict", "reserve", "broad", "external", "substring")


def tiered_search(nodes: DataFrame, queries: DataFrame, limit: int = 20, max_probe: int = 8) -> DataFrame:
    """(qid, id, tier, position): the staged search of many queries in one plan. queries: (qid, query).

    Stages in order, each opened for a query only while earlier ones gave too little, judged by counts per query:

    * path (three words or more; only if it fills half of the limit), column (qname, name, path; only if it fills the limit), strict (all words, BM25);
    * reserve: the column hits after all, where there are fewer than half of the limit; broad: any word, to fill up. Queries of more than
      ``max_probe`` words go to broad alone;
    * of all these, the best one by path priority moves to the first place;
    * external: external symbols fill what is left; substring: a query without any hit gets nodes whose qname, name, path or doc contains it.

    Within a query a node keeps its first stage. Empty queries find nothing.
    """
    posts = index(nodes)
    half = max(1, limit // 2)
    size = queries.select("qid", "query", F.size(query_tokens("query")).alias("n"))
    counted = lambda hits: hits.groupBy("qid").agg(F.countDistinct("id").alias("c"))
    short = size.filter(F.col("n") <= max_probe)
    path = any_field(posts, short.filter(F.col("n") >= 3), ("path",), limit)
    enough = counted(path).filter(F.col("c") >= half).select("qid")
    path = path.join(enough, "qid", "left_semi")
    open_ = short.join(enough, "qid", "left_anti")
    column = stored(any_field(posts, open_, ("qname", "name", "path"), limit), "column-tier")
    full = counted(column).filter(F.col("c") >= limit).select("qid")
    strict = bm25(posts, open_.join(full, "qid", "left_anti"), True, limit)
    stage = lambda d, t: d.select("qid", "id", F.lit(t).alias("t"), "position")
    first = stored(stage(path, 0).unionByName(stage(column.join(full, "qid", "left_semi"), 1)).unionByName(stage(strict, 2)), "first-tiers")
    few = short.join(counted(first).filter(F.col("c") >= half), "qid", "left_anti")
    first = first.unionByName(stage(column.join(few, "qid", "left_semi"), 3))
    missing = size.join(counted(first), "qid", "left").fillna(0, ["c"]).filter(F.col("c") < limit)
    room = missing.select("qid", F.when(F.col("c") >= half, limit - F.col("c") + 2).otherwise(limit).alias("room"))
    broad = any_field(posts, missing, FIELDS, limit).join(room, "qid").filter(F.col("position") <= F.col("room"))
    best = first.unionByName(stage(broad, 4)).groupBy("qid", "id").agg(F.min(F.struct("t", "position")).alias("b")).select("qid", "id", "b.t", F.col("b.position").alias("p"))
    ranked = best.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("t", "p", "id")))
    found = stored(promote(ranked, nodes).join(best.select("qid", "id", "t"), ["qid", "id"]).filter(F.col("place") <= limit).select("qid", "id", "t", F.col("place").alias("position")), "found")
    open_ = queries.join(counted(found), "qid", "left").fillna(0, ["c"]).filter(F.col("c") < limit)
    more = external_fill(nodes, open_.select("qid", "query"), limit).join(open_.select("qid", "c"), "qid").withColumn("position", F.col("position") + F.col("c")).filter(F.col("position") <= limit)
    found = found.unionByName(stage(more, 5))
    none = stored(queries.join(found, "qid", "left_anti").filter(F.length("query") > 0), "no-hits")
    if not none.isEmpty():
        found = found.unionByName(stage(containing(nodes, none, limit), 6))
    return found.select("qid", "id", F.element_at(F.array(*map(F.lit, TIERS)), F.col("t") + 1).alias("tier"), F.col("position").cast("int").alias("position"))


def containing(nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, id, position): nodes whose qname, name, path or doc contains the query, whatever the case; external ones last, equal names first, short names before long ones."""
    whole = nodes.select("*", F.concat_ws("\x00", "qname", "name", "path", "doc").alias("_text"))
    hits = substring_hits(whole, queries.select("query").distinct(), "_text", ["id", "name", "qname", "kind"]).join(queries, "query")
    order = [F.coalesce(F.col("kind").isin(*EXTERNAL), F.lit(False)).cast("int"), F.coalesce(F.lower("name") != F.lower("query"), F.lit(True)).cast("int"), F.length("qname"), F.col("id")]
    return first_per_query(hits, order, limit).select("qid", "id", "position")


def path_priority(path: Column | str) -> Column:
    """Sources 0, scripts and the like 1, tests 2, prose 3."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return (
        F.when(p.rlike(r"(^|/)(readme|agents)[^/]*$|^(docs|skills)/"), 3).when(p.rlike(r"(^|/)tests?/"), 2).when(p.startswith("src/"), 0).otherwise(1)
    )


def promote(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with the best one by path priority moved to the first place of its query."""
    paths = nodes.select("id", "path", "start_line", "qname")
    both = hits.join(paths, "id").withColumn("priority", path_priority("path"))
    w = Window.partitionBy("qid")
    first = F.row_number().over(w.orderBy("priority", "position", "path", "start_line", "qname", "id")) == 1
    both = both.withColumn("moved", F.when(first, 0).otherwise(F.col("position")))
    return both.withColumn("place", F.row_number().over(w.orderBy("moved", "id"))).select("qid", "id", "path", "priority", "place")


def external_fill(nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, id, qname, position): external symbols one of whose name parts is a word of the query, exact names first.

    Apart from exact names, the order is the same for all queries. So what comes first is among the ``limit`` first symbols of each word and the ``limit`` first of the query's
    own name: both are cut inside the tasks before queries meet them, and a query meets at most limit symbols for each of its words and for its name.
    """
    ext = nodes.filter(F.col("kind").isin(*EXTERNAL)).select("id", F.lower("name").alias("low"), "qname", F.coalesce("path", F.lit("")).alias("path"), "start_line", F.array_distinct(terms("name")).alias("words")).filter(F.size("words") > 0)
    order = [F.length("qname"), F.col("path"), F.col("start_line"), F.col("id")]
    first = lambda rows, by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")
    asked = query_terms(queries)
    with_word = first(ext.withColumn("term", F.explode("words")).drop("words").join(asked.select("term").distinct(), "term", "left_semi"), "term").join(asked.select("qid", "term"), "term")
    low = queries.select("qid", F.lower("query").alias("low"))
    named = first(ext.drop("words").join(low.select("low").distinct(), "low", "left_semi"), "low").join(low, "low").withColumn("exact", F.lit(True))
    cols = ["qid", "id", "qname", "path", "start_line", "exact"]
    hits = with_word.join(low.withColumnRenamed("low", "query"), "qid").withColumn("exact", F.col("low") == F.col("query")).select(*cols).unionByName(named.select(*cols)).distinct()
    return first_per_query(hits, [(~F.col("exact")).cast("int"), *order], limit).select("qid", "id", "qname", "position")
