"""Spelling variants: pairs of words that are one edit apart, by an errata trie.

The words form a trie. At each node that branches, the child with most words is the heavy one; all others,
a word's end included, are light. Light subtrees are merged with what lies beside them under one edit of the
character that leads into them: it is skipped, replaced by the heavy child's or by anything, or the heavy child's stands
before it. Where the terminal of an edited word coincides with another's, the two are one edit apart. A pair parts
at one node, where at least one of the two is light, so each pair is found once; and a word is light at no more than
log2(words) nodes, so only that many of its characters are edited.

Nodes are rows keyed by the hash of their prefix. Two prefixes of one hash would share their heavy child, and
any child will do for that, as long as all words of a node know the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.llm.common import materialise, whole_text

#: Fixed pattern of a run of letters.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes that more than a share of 1 / TOP of all words pass, down to a depth of TOP_DEPTH, are broadcast: TOP * TOP_DEPTH rows at most.
TOP, TOP_DEPTH = 512, 64
#: What stands for any character; no word has it.
ANY = "*"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5, slip: int = 199) -> DataFrame:
    """``(word, n)``: the distinct lower-cased runs of letters with at least ``least_chars`` of them that occur ``least_n`` times or more.

    A run whose crc32 with its document's id divides by ``slip`` loses one letter, as a slip of the hand would; null ids are as empty
    ones. Null and empty texts have no words, long ones are read whole, repeated rows count again.
    """
    run = F.explode(F.regexp_extract_all(F.translate(whole_text(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id_"), run.alias("run_")).where(F.length("run_") >= least_chars)
    hashed = runs.select("run_", F.crc32(F.concat("id_", "run_")).alias("h"))
    cut = F.when(F.col("h") % slip == 0, F.expr("concat(left(run_, cast(h % length(run_) as int)), substr(run_, cast(h % length(run_) as int) + 2))"))
    spelt = hashed.select(F.coalesce(cut, "run_").alias("word")).where(F.length("word") >= least_chars)
    return spelt.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _steps() -> Column:
    """A row for each node on a word's way: its depth, its prefix's hash, and the character that follows, empty at the end."""
    return F.inline(
        F.expr("transform(sequence(0, length(word)), i -> named_struct('depth', i, 'node', xxhash64(i, left(word, i)), 'next', substr(word, i + 1, 1)))")
    )


def lights(numbered: DataFrame) -> DataFrame:
    """``(id, depth, next, heavy)`` of the nodes at which a word of ``(id, word)`` is light: ``next`` is its character there, empty
    at its end, ``heavy`` that of the heavy child."""
    steps = numbered.select("id", _steps())
    children = steps.groupBy("node", "depth", "next").agg(F.count("*").alias("n"))
    branches = materialise(
        children.groupBy("node", "depth").agg(F.max(F.when(F.col("next") != "", F.struct("n", "next"))).alias("most"), F.sum("n").alias("size"), F.count("*").alias("kids"))
        .where("kids > 1").select("node", "depth", F.col("most.next").alias("heavy"), "size"),
        "spelling-nodes",
    )
    often = (F.col("size") * TOP > numbered.count()) & (F.col("depth") < TOP_DEPTH)
    top = branches.where(often).select("node", "depth", F.col("heavy").alias("top"))
    rest = branches.where(~often).select("node", "depth", "heavy")
    met = steps.join(F.broadcast(top), ["node", "depth"], "left")
    at_top = met.where("top is not null").select("id", "depth", "next", F.col("top").alias("heavy"))
    below = met.where("top is null").drop("top").join(rest, ["node", "depth"]).select("id", "depth", "next", "heavy")
    return at_top.unionByName(below).where("next <> heavy")


def near_words(counted: DataFrame) -> DataFrame:
    """``(word, n_near, best)`` of the words of ``(word, n)`` that have near ones: how many words are one inserted, deleted or replaced
    character away, and the most frequent of them as a struct of ``-n`` and ``word``, the smallest of equally frequent ones."""
    numbered = materialise(counted.select("word", "n", F.monotonically_increasing_id().alias("id")), "spelling-words")
    edited = materialise(
        lights(numbered.select("id", "word")).join(numbered, "id")
        .select("word", "n", "next", "heavy", F.expr("left(word, depth)").alias("head"), F.expr("substr(word, depth + 1)").alias("tail"), F.expr("substr(word, depth + 2)").alias("rest")),
        "spelling-light",
    )
    inside = F.col("next") != ""
    skipped = F.when(inside & (F.substring("rest", 1, 1) != F.col("next")), F.concat("head", "rest"))  # of a run of one letter the last goes, once
    keys = F.array_compact(F.array(F.concat("head", "heavy", "tail"), F.when(inside, F.concat("head", "heavy", "rest")), skipped))
    other = numbered.select(F.col("word").alias("key"), F.col("n").alias("other_n"))
    met = edited.select("word", "n", F.explode(keys).alias("key")).join(other, "key")
    seen = lambda word, n, near: F.struct(F.col(word).alias("word"), F.struct((-F.col(n)).alias("n"), F.col(near).alias("word")).alias("best"))
    met = met.select(F.inline(F.array(seen("word", "other_n", "key"), seen("key", "n", "word")))).select("word", F.lit(1).alias("k"), "best")
    # light ones that differ in the character alone: no more than the alphabet has
    alike = edited.where(inside).groupBy(F.concat("head", F.lit(ANY), "rest").alias("key")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all"))
    alike = alike.where(F.size("all") > 1).select("all", F.explode("all").alias("own"))
    alike = alike.select(F.col("own.word").alias("word"), (F.size("all") - 1).alias("k"), F.when(F.col("own") == F.col("all")[0], F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    return met.unionByName(alike).groupBy("word").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last of the forms that follow from each. Each round doubles the steps; a form is several
    times as frequent as its word, so ways are short."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5, times: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of ``words``: its most frequent near word if that is at least ``times`` as frequent, else null,
    and the last form that follows from it, itself if there is none.

    Null, empty and long texts, null ids and repeated rows are as in ``words``; ties go to the smallest word in the order of code points;
    other columns, of any name, are left out. An empty table gives no rows.
    """
    counted = materialise(words(docs, id_col, text_col, least_chars, least_n), "spelling-counts")
    near = counted.join(near_words(counted), "word", "left")
    form = F.when(-F.col("best.n") >= F.lit(times) * F.col("n"), F.col("best.word"))
    named = materialise(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n")), "spelling-forms"
    )
    rooted = roots(named.where("form is not null").select("word", "form"))
    return named.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
